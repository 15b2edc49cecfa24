import random

import pytest

import corpus_pipeline
from lumenta.llm import minhash, mixing, tokens
from tests.llm import test_lines, test_minhash, test_packing

WORDS = {"en": ["the", "house", "with", "thing", "other", "through"], "de": ["der", "haus", "straße", "nicht", "und", "schön"], "fr": ["les", "maison", "été", "avec", "dans", "où"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    sentence = lambda k: " ".join(rng.choice(WORDS[k]) + str(rng.choice(["", "", rng.choice(WORDS[k])])) for _ in range(rng.randint(5, 30)))
    rows = []
    for i in range(150):
        k = rng.choice(list(WORDS))
        rows.append([i, "\n".join(sentence(k) for _ in range(rng.randint(1, 6))), k if i % 7 else None, rng.choice("aabc"), 0])
    for i in range(150, 190):
        base = list(rng.choice(rows[:150]))
        words = base[1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "zzz"
        rows.append([i, " ".join(words), base[2], base[3], 0])
    rows += [[190, None, "en", "a", 0], [191, "12 345 !!", "en", None, 0], [192, "", None, None, None]]
    rows += [list(rows[3]), [None, "the house with the other thing through the house", None, None, None]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def key(rows):
    return sorted(str((r.doc_id, r.text, r.source)) for r in rows)


def test_each_stage_against_brute_force(spark, docs):
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept.collect()
        after = stage(spark, kept, "")
        if name != "packing":
            assert after.columns == docs.columns
        rows = after.collect()
        if name == "language_id":
            assert key(rows) == key(r for r in before if any(c.isalpha() for c in r.text or ""))
            known = {(r.doc_id, r.text): r.lang for r in before}
            assert all(r.lang == (known[r.doc_id, r.text] or r.lang) and r.lang for r in rows)
        if name == "line_dedup":
            cut = [eval(x) for x in test_lines.by_hand([(r.doc_id, r.text) for r in before])]
            assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((d, t)) for d, t, _, gone in cut if not gone or t.strip())
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            want = {eval(x)[2] for x in test_minhash.by_hand([(r.doc_id, r.text) for r in before], 5, 80)}
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, want))
        if name == "mixing":
            plan = mixing.plan(kept).collect()
            assert key(rows) == key(r for r in plan for _ in range(r.copies)) and len(rows) > 0
        if name == "packing":
            test_packing.whole(rows)
            encode = tokens.encoder(tokens.vocabulary())
            assert sum(r.length for r in rows) == sum(len(encode(r.text)) + 1 for r in before)
        seen[name] = len(rows)
        kept = spark.createDataFrame(rows, after.schema).repartition(3).cache()
    assert seen["line_dedup"] > seen["near_duplicates"]


def test_run_and_empty_tables(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert minhash.BANDS * minhash.ROWS == 150
