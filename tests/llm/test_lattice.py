import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenta.llm import language_id, lattice, lm_scoring


@pytest.fixture(scope="module")
def model():
    return lattice.lattice(lattice.vocabulary())


def segmentations(model, word):
    """Every way to spell a marked word, as lists of piece ids."""
    if not word:
        return [[]]
    out = []
    for j in range(1, min(len(word), model.longest) + 1):
        k = model.ids.get(word[:j])
        if k is not None:
            out += [[k, *rest] for rest in segmentations(model, word[j:])]
        elif j == 1:
            out += [[*model.bytes[list(word[0].encode())], *rest] for rest in segmentations(model, word[1:])]
    return out


WORDS = ["the", "in", "x", "日本語", "zß😀", "erheing", "a\x00b", "ÀB"]


def test_score_sums_all_segmentations(model):
    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(model.size), 2).T)
    got = model.score(WORDS, logp)
    for w, row in zip(WORDS, got, strict=True):
        ways = segmentations(model, lattice.BEGIN + w)
        for k in range(2):
            assert math.isclose(row[k], np.logaddexp.reduce([logp[s, k].sum() for s in ways]), rel_tol=1e-9)


def test_expected_counts(model):
    logp = np.log(np.random.default_rng(2).dirichlet(np.ones(model.size), 1).T)
    weights = np.arange(1.0, len(WORDS) + 1)[:, None]
    want = np.zeros(model.size)
    for w, n in zip(WORDS, weights[:, 0], strict=True):
        ways = segmentations(model, lattice.BEGIN + w)
        lp = np.array([logp[s, 0].sum() for s in ways])
        for s, p in zip(ways, np.exp(lp - np.logaddexp.reduce(lp)), strict=True):
            np.add.at(want, s, n * p)
    assert np.allclose(model.expected(WORDS, weights, logp)[:, 0], want)


@pytest.mark.parametrize("part", [7, 64, 2048])
def test_long_words_in_parts(model, monkeypatch, part):
    """A word long enough for the bounded recursions has the score and the expected counts of the plain ones."""
    monkeypatch.setattr(lattice, "PART", part)
    rng = random.Random(8)
    words = ["ab😀cd" * 60, "".join(rng.choice(["ing", "e", "▁", "日本", "\U0001F9FF", "=", "ß", "tion"]) for _ in range(150)), "=" * 300, "\U000F0000" * 250]
    logp = np.log(np.random.default_rng(3).dirichlet(np.full(model.size, 0.05), 2).T + 1e-12)
    weights = np.array([[1.0, 2.0], [3.0, 0.5], [1.0, 1.0], [2.0, 0.0]])
    score, counts = model.score(words, logp), model.expected(words, weights, logp)
    monkeypatch.setattr(lattice, "LONG", 10_000)
    assert np.allclose(score, model.score(words, logp), rtol=1e-9)
    assert np.allclose(counts, model.expected(words, weights, logp), rtol=1e-7, atol=1e-9)


def test_word_of_megabytes(model):
    """Without a space for 2 MB, scored; and learned from in memory that doesn't grow with the word."""
    logp = model.prior()[:, None]
    word = "".join(random.Random(9).choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=2_000_000))
    assert model.score([word], logp)[0, 0] < -1e6
    n = 1 << 16
    tracemalloc.start()
    total = model.expected([word[:n]], np.ones((1, 1)), logp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20 and n / 4 < total.sum() <= n + 1


@pytest.mark.parametrize("kinds", [None, 2, 5])
def test_lm_against_brute_force(spark, model, kinds):
    rng = random.Random(4)
    pool = ["The", "the", "of", "straße", "x1", "erheing", "ÉTÉ", "日本"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(300):
        k = rng.choice([None, *range(kinds)]) if kinds else None
        rows.append((i, " ".join(rng.choice(pool[(k or 0) * 3 :]) for _ in range(rng.randint(0, 40))), k))
    rows.append((300, "novel unseen", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang int").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score(df if kinds else df.drop("lang"), most=3).collect()}
    low = lambda t: t.translate({i: i + 32 for i in range(65, 91)}).split()
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    order = sorted(Counter(r[2] for r in learned).items(), key=lambda x: (-x[1], x[0] is not None, str(x[0])))
    names = [k for k, _ in order][:4]
    of = {k: min(i, len(names) - 1) for i, (k, _) in enumerate(order)}
    train = [Counter() for _ in names]
    for _, t, k in learned:
        train[of[k]].update([*low(t), None])
    every = sum(train, Counter())
    n, v = sum(every.values()), len(every)
    words = [w for w in every if w]
    logp = np.repeat(model.prior()[:, None], len(names), axis=1)
    for _ in range(lm_scoring.ROUNDS):
        logp = lattice.normalised(model.expected(words, np.array([[float(c[w]) for c in train] for w in words]), logp), lm_scoring.SMOOTH)

    def chance(k, w):
        c, own = train[k], [x for x in train[k] if x]
        total, once, twice = sum(c[x] for x in own), sum(c[x] == 1 for x in own), sum(c[x] == 2 for x in own)
        d = once / (once + 2 * twice) if once and twice else 0.5
        pieces = math.exp(model.score([w], logp)[0, k])
        spread = 0.3 * every[w] / (n - every[None]) + 0.7 * pieces
        return (1 - (c[None] + 0.5) / (c[None] + total + 1)) * (max(c[w] - d, 0) + d * len(own) * spread) / total

    for i, t, _ in rows:
        own, r = [*low(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(every[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((every[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        pieces, parts = [], []
        for k, c in enumerate(train):
            total = sum(c.values())
            end = (c[None] + 0.5) / (total + 1)
            lp = math.log((c[None] + 1) / (every[None] + len(train))) + math.log(end)
            pieces.append(lp + sum(model.score([w], logp)[0, k] + math.log(1 - end) for w in low(t)))
            parts.append(lp + sum(math.log(chance(k, w)) for w in low(t)))
        assert math.isclose(r.score, np.logaddexp.reduce(pieces) / math.log(10), rel_tol=1e-5)
        assert math.isclose(r.word_score, np.logaddexp.reduce(parts) / math.log(10), rel_tol=1e-5)


def test_long_unspaced_text_is_learned_from(spark):
    word = "".join(random.Random(10).choices("abcdefghij", k=60_000))
    got = lm_scoring.score(spark.createDataFrame([(1, word, "en"), (2, "a b", "en"), (2, "a b", "en")], "doc_id long, text string, lang string")).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, 2), (2, 3), (2, 3)] and all(math.isfinite(r.score) for r in got)


def test_lm_odd_rows(spark, odd, none):
    got = lm_scoring.score(odd("train")).collect()
    assert len(got) == 9 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 2] == [1]
    assert lm_scoring.score(none).count() == 0


def test_languages_held_out(spark):
    rng = random.Random(5)
    own = {"en": ["the", "house", "with", "thing", "other"], "de": ["der", "haus", "straße", "nicht", "und"], "fr": ["les", "maison", "été", "avec", "dans"]}
    rows = [(i, " ".join(rng.choice(own[k]) + rng.choice(own[k]) for _ in range(rng.randint(2, 20))), k) for i in range(600) for k in [rng.choice(list(own))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df, language_id.fit(df)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == 600 and sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_posterior_against_brute_force(spark, model):
    """Fit and posterior recomputed from every segmentation of every word."""
    rng = random.Random(6)
    pool = {"en": ["the", "of", "Köln", "x"], "de": ["der", "of", "ß"], None: ["the", "der"]}
    kinds = [rng.choice(["en", "en", "de", None]) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(pool[k]) + rng.choice(["", "!", "7"]) for _ in range(rng.randint(0, 6))), k) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    fitted = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.predict(df, fitted).collect()}
    letters = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t).split()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2]]
    langs = sorted({r[2] for r in train})
    counts = [Counter(w for r in train if r[2] == k for w in letters(r[1])) for k in langs]
    logp = [model.prior() for _ in langs]
    ways = {w: segmentations(model, lattice.BEGIN + w) for w in {w for r in rows for w in letters(r[1])}}
    for _ in range(language_id.ROUNDS):
        for k in range(len(langs)):
            total = np.full(model.size, language_id.SMOOTH)
            for w, n in counts[k].items():
                lp = np.array([logp[k][s].sum() for s in ways[w]])
                for s, p in zip(ways[w], np.exp(lp - np.logaddexp.reduce(lp)), strict=True):
                    np.add.at(total, s, n * p)
            logp[k] = np.log(total / total.sum())
    prior = [math.log(sum(r[2] == k for r in train) / len(train)) for k in langs]
    for i, text, _ in rows:
        words, r = letters(text), got[i]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lp = np.array([prior[k] + sum(np.logaddexp.reduce([logp[k][s].sum() for s in ways[w]]) for w in words) for k in range(len(langs))])
        p = np.exp(lp - np.logaddexp.reduce(lp))
        assert r.lang_pred == langs[int(p.argmax())] and math.isclose(r.score, p.max(), rel_tol=1e-6)


def test_languages_odd_rows(odd, none):
    for extra in ("score", "lang_pred", "__text2"):
        df = odd(extra)
        got = language_id.predict(df, language_id.fit(df)).collect()
        assert len(got) == 9 and all((r.lang_pred == "und") == (r.doc_id in (2, 3, 8)) for r in got)
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd(), language_id.fit(none)).collect()} == {"und"}
