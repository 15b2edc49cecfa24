import random

from lumenta.llm import lines


def by_hand(rows):
    seen, gone = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        ls = (rows[k][1] or "").split("\n")
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if w in seen:
                gone.setdefault(k, set()).update((i, i + 1, i + 2))
            seen.add(w)
    out = []
    for k, (doc, text) in enumerate(rows):
        ls = [] if text is None else text.split("\n")
        kept = text if k not in gone else "\n".join(x for i, x in enumerate(ls) if i not in gone[k])
        out.append(str((doc, kept, len(ls), sorted(gone.get(k, [])))))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    for _ in range(3):
        ids = rng.sample(range(1000), 80)
        rows = [(i, "\n".join(rng.choice(["a", "b", "", "c" + str(rng.randint(0, 5))]) for _ in range(rng.randint(1, 12)))) for i in ids]
        got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(str(tuple(r)) for r in got) == by_hand(rows)


def test_odd_rows(spark, odd, none):
    for extra in ("row", "lines", "N_Lines", "__row"):
        df = odd(extra)
        got = lines.deduplicated(df)
        assert len(got.columns) == len([c for c in df.columns if c != "N_Lines"]) + 2
        assert sorted(str((r.doc_id, r.text, r.n_lines, r.removed)) for r in got.collect()) == by_hand([(r.doc_id, r.text) for r in df.coalesce(1).collect()])
    assert lines.deduplicated(none).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\n" * 5)], "doc_id long, text string").coalesce(1)
    assert sorted(str(tuple(r)) for r in lines.deduplicated(twice).collect()) == by_hand([(r.doc_id, r.text) for r in twice.collect()])
