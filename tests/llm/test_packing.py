import bisect
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenta.llm import packing, tokens


def check_runs(counts, runs, capacity):
    seen = defaultdict(list)
    for r in runs:
        assert sum(n for n, _ in r.slots) + r.gap == capacity and r.gap >= 0 and r.count > 0
        for n, first in r.slots:
            seen[n] += range(first, first + r.count)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items() if n}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 40)), st.integers(1, 30))
def test_every_piece_has_one_place(counts, groups):
    check_runs(counts, packing.arrange(counts, 64, groups), 64)


@pytest.mark.parametrize("law", ["even", "short", "long", "hot"])
def test_few_sequences(spark, law):
    """Beside a running session, whose threads a threaded matrix library would wait for."""
    began = time.time()
    rng = random.Random(5)
    draw = {"even": lambda: rng.randint(1, 1023), "short": lambda: min(1023, int(rng.expovariate(1 / 150)) + 1), "long": lambda: rng.randint(200, 700), "hot": lambda: 300 if rng.random() < 0.4 else rng.randint(1, 1023)}[law]
    counts = Counter(draw() for _ in range(30_000))
    runs = packing.arrange(counts)
    check_runs(counts, runs, 1024)
    gaps, plain = [], 0  # best-fit decreasing, one piece after the other
    for k in sorted(counts.elements(), reverse=True):
        i = bisect.bisect_left(gaps, k)
        plain += i == len(gaps)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else 1024) - k)
    assert sum(r.count for r in runs) <= 1.01 * plain + 2, (law, sum(r.count for r in runs), plain)
    assert len(runs) < 20_000 and time.time() - began < 120


def test_fillings_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(5, 40), 6, replace=False))
        values = rng.random(6)
        ways = [()]
        for w in ways:
            ways += [(*w, i) for i in range(w[-1] if w else 0, 6) if sizes[list(w)].sum() + sizes[i] <= 40]
        worth = {w: values[list(w)].sum() for w in ways}
        best, found = packing.fillings(sizes, values, 40)
        assert abs(best - max(worth.values())) < 1e-9 and len(found) == 6
        firsts = {w: v for w, v in worth.items() if w}
        for i in range(6):
            own = max(v for w, v in firsts.items() if i in w)
            assert any(abs(sum(values[k] * n for k, n in f.items()) - own) < 1e-9 and f[i] for f in found)


def test_configurations_reach_the_bound():
    """A case with a known optimum: thirds and halves of a sequence, which fill it wholly."""
    found = packing.configurations([512, 341, 170], [200, 600, 100], 1024)
    assert sum(n for _, n in found) <= 100 + 200 + 17 and all(sum([512, 341, 170][i] for i in f) <= 1024 for f, _ in found)


def whole(rows):
    """Checks the places of pieces; returns the pieces of each document."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    return by_sequence


def test_pieces_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "Straße", "naïve", "x", "<|endoftext|>", "日本", "it's"]) for _ in range(rng.randint(0, 1500)))) for i in range(150)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sequences = whole(got)
    full = tokens.encoder(tokens.vocabulary()).full
    total = 0
    for doc, text in rows:
        ids = np.array([*full.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
        total += at
    assert len(sequences) <= 1.03 * total / 1024 + 2


def test_odd_rows(odd, none):
    got = packing.pack(odd("length")).collect()
    whole(got)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.piece == 0) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd().collect())
    assert packing.pack(none).count() == 0
