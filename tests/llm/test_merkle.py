import hashlib
import random

from pyspark.sql import functions as F

from lumenta.llm import merkle


def by_hand(rows):
    """Neighbours and edits, computed in Python."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(order):
        nxt, text = order[(i + 1) % len(order)][1] or "", text or ""
        k = len(text) // 3
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - k] + nxt[:k]).encode()).hexdigest()))
    return sorted(map(str, out))


def test_edits_and_neighbours(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**9), 300)
    rows = [(i, "\n".join("".join(rng.choice("ab. é😀") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 20)))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = merkle.edited_fingerprints(df).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == by_hand(rows)
    texts = dict(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same = hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.edited_sha256
        assert same == (r.fingerprint == r.edited_fingerprint)


def test_branches_locate_an_edit(spark):
    lines = [f"line number {i} is here." for i in range(40)]
    other = [*lines[:17], "changed.", *lines[18:]]
    r = merkle.trees(spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string"), x="a", y="b").select(
        merkle.changed_sections(F.col("x"), F.col("y")).alias("at"), merkle.likeness(F.col("x"), F.col("y")).alias("near")).first()
    assert r["at"] == [17 // merkle.SECTION] and r.near > 0.95


def test_rows_without_ids_are_spread(spark):
    rng = random.Random(4)
    rows = [(None, rng.choice(["", None, "common start of all: ", "é"]) or None) for _ in range(20)] + [(None, "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 30)))) for _ in range(200)] + [(i, f"text {i}") for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = merkle.edited_fingerprints(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == by_hand(rows)


def test_odd_rows(spark, odd, none):
    got = merkle.edited_fingerprints(odd("bucket")).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == by_hand([(r.doc_id, r.text) for r in odd().collect()])
    assert len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    assert merkle.edited_fingerprints(none).count() == 0
    one = merkle.edited_fingerprints(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and one.near_next == 1.0
