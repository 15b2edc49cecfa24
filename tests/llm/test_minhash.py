import random

import pytest

from lumenta.llm import minhash


def by_hand(rows, k, percent):
    """All pairs, on sets of shingles as tuples."""
    sets = []
    for _, text in rows:
        w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(str((doc, len(sets[i]), least.get(top(i)), doc == least.get(top(i)))) for i, (doc, _) in enumerate(rows))


def corpus(rng, groups, size, edits):
    """Groups of near copies, more or less edited, so that links lie on both sides of the threshold."""
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(["X", "y", "Zé", "w" + str(rng.randint(0, 9))])
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(zip(rng.sample(range(10**6), len(rows)), rows, strict=True))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    rows = corpus(random.Random(k), 25, 25, 7)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k, percent).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == by_hand(rows, k, percent)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIDE", 5)
    rows = corpus(random.Random(9), 4, 60, 9)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == by_hand(rows, 3, 85)


def test_long_texts_linked_only_beside_foreign_hubs(spark):
    """Minima of long texts agree in their upper halves by chance, which must not count as a shared bucket."""
    rng = random.Random(10)

    def words(n):
        return [f"n{rng.getrandbits(40)}" for _ in range(n)]

    core = words(24_000)
    rows = [(i, " ".join(core + words(n))) for i, n in enumerate([9_600] * 16 + [2_400] * 2)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1, 80).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == by_hand(rows, 1, 80)
    assert len({r.component_id for r in got}) == 17


def test_components_of_a_path(spark):
    rng = random.Random(3)
    n = list(range(60))
    rng.shuffle(n)
    links = [(a, b) for a, b in zip(n[:40], n[1:40], strict=False)] + [(n[50], n[51]), (n[51], n[52])]
    got = dict(map(tuple, minhash.components(spark.createDataFrame(links, "a long, b long")).collect()))
    for part in (n[:40], n[50:53]):
        assert all(got.get(x, x) == min(part) for x in part)


def test_odd_rows(odd, none):
    df = odd("row")
    got = minhash.near_duplicates(df).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == by_hand([(r.doc_id, r.text) for r in df.collect()], 5, 80)
    assert minhash.near_duplicates(none).count() == 0


def test_representatives(spark, odd):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (1, "a b c d e f g"), (3, "other text here"), (4, None), (4, None), (5, " "), (3, "x y z w v u t")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, `row` string")
    got = minhash.representatives(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id <> 2").distinct().union(df.where("doc_id = 4").limit(1)).collect()))
    assert minhash.representatives(odd("kept")).count() == 8
