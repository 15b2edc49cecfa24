import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenta.llm import suffixes


def by_hand(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append(str((doc, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def check(spark, rows):
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in got) == by_hand(rows)


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([lambda: " ".join(word() for _ in range(rng.randint(0, 80))), lambda: rng.choice(passages), lambda: rng.choice(passages)[rng.randint(0, 40) :]])() for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    return rows + [(n + i, rows[rng.randrange(n)][1]) for i in range(5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, corpus(random.Random(seed), 60))


def test_hot_anchors_and_batches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 7)
    monkeypatch.setattr(suffixes, "BATCH", 3)
    monkeypatch.setattr(suffixes, "WHOLE_BATCH", 3)
    check(spark, corpus(random.Random(3), 80))


def test_periodic_texts(spark):
    check(spark, [(1, "a" * 500), (2, "ab" * 260), (3, "abc " * 40), (4, "x" * 199), (5, "y" * 200), (6, "z" * 201), (7, "ba" * 150 + "q" * 30), (8, "a" * 250 + "\0" * 220)])


def test_family_merges_levels():
    rng = random.Random(5)
    family, every = suffixes.Family(), []
    for _ in range(23):
        batch = [bytes(rng.choice(b"ab") for _ in range(6)).ljust(200, b".") for _ in range(rng.randint(0, 9))]
        every += batch
        family.add(np.array(batch, "S200"))
    n = Counter(every)
    assert family.repeated.tolist() == [n[x] > 1 for x in every]
    assert len(family.levels) <= 5 and [x[0] for x in family.levels] == sorted((x[0] for x in family.levels), reverse=True)


def test_odd_rows(spark, odd, none):
    got = suffixes.repeats(odd("row")).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in got) == by_hand([(r.doc_id, r.text) for r in odd().collect()])
    assert suffixes.repeats(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_shards_have_levels(spark):
    """With production parameters a shard's batches meet levels of earlier ones, of windows and of whole units."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = suffixes.matches(docs)[2]
    most = {r[0]: r[1] for r in found.groupBy(F.col("k1").isNotNull()).agg(F.max("levels")).collect()}
    assert most[False] >= 3 and most[True] >= 2


def test_bytes_decide_about_wholes():
    table = suffixes.pa.table({"shard": [-1, -1], "k1": [5, 5], "k2": [6, 6], "span": [b"a" * 250, b"a" * 251]})
    assert suffixes._matched(table).num_rows == 0
    table = suffixes.pa.table({"shard": [-1] * 4, "k1": [5, 5, 7, 7], "k2": [6, 6, 8, 8], "span": [b"a" * 250, b"a" * 250, b"b" * 249 + b"\0", b"b" * 249]})
    assert suffixes._matched(table).select(["k1", "k2"]).to_pylist() == [{"k1": 5, "k2": 6}]
