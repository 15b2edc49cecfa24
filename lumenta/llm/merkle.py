"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame functions only.

A paragraph is a line. Its leaves are pieces of at most 64 code points that end at
the end of a sentence where one comes sooner, so a change moves no leaf before it
and none after the next sentence end. A paragraph's hash is that of its leaves'
hashes, a section's (eight paragraphs) that of its paragraphs', the root that of
the sections'. Equal roots mean equal texts; where roots differ, equal branches
need no look, and the differing ones say where the edit is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenta.llm.common import fresh, parts

PIECE = "[^.!?]{1,64}[.!?]*|[.!?]+"
SECTION = 8
#: Hex digits of a hash inside the tree; the root has all 32.
DIGITS = 16


def _hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, DIGITS)


def leaves(text: Column) -> Column:
    """Arrays of leaf hashes, one for each paragraph."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), _hash))


def paragraphs(leaf_hashes: Column) -> Column:
    return F.transform(leaf_hashes, lambda x: _hash(F.array_join(x, "")))


def sections(paragraph_hashes: Column) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.size(paragraph_hashes) - 1) / SECTION).cast("int"))
    return F.transform(starts, lambda i: _hash(F.array_join(F.slice(paragraph_hashes, i * SECTION + 1, SECTION), "")))


def root(section_hashes: Column) -> Column:
    return F.md5(F.array_join(section_hashes, ""))


def trees(df: DataFrame, **texts: str) -> DataFrame:
    """df plus a struct (root, sections, paragraphs, leaves) for each name=text column; null texts count as empty."""
    out = df
    for name, text in texts.items():
        a, b, c = (fresh(out, f"__{name}{i}") for i in range(3))
        out = out.withColumn(a, leaves(F.coalesce(F.col(text), F.lit(""))))
        out = out.withColumn(b, paragraphs(F.col(a)))
        out = out.withColumn(c, sections(F.col(b)))
        out = out.withColumn(name, F.struct(root(F.col(c)).alias("root"), F.col(c).alias("sections"), F.col(b).alias("paragraphs"), F.flatten(a).alias("leaves"))).drop(a, b, c)
    return out


def printed(tree: Column) -> Column:
    """A tree as text: its root, then the hashes of each level."""
    return F.concat_ws("/", tree["root"], *[F.array_join(tree[k], ",") for k in ("sections", "paragraphs", "leaves")])


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the part of the larger one's distinct leaves that both have."""
    x, y = F.array_distinct(a["leaves"]), F.array_distinct(b["leaves"])
    most = F.greatest(F.size(x), F.size(y))
    return F.when(a["root"] == b["root"], F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / most)


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections in which two trees differ."""
    n = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))


def _head(text: Column) -> Column:
    """The first six bytes of texts as a number; texts are ordered as their bytes are."""
    return F.conv(F.rpad(F.hex(F.substring(F.coalesce(text, F.lit("")).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, columns: list[str], prefix: str = "next_") -> DataFrame:
    """docs plus the given columns of the next row by descending doc_id, cyclic; ties by text, null ids last.

    Rows are dealt to ranges of ids by quantiles, those without an id to ranges of their
    texts' first bytes. The first of each range is also sent to the range before it, so
    that a window in each range sees all neighbours and no window spans the whole table.
    Rows of one id, and rows without an id of which six bytes agree, share a range.
    """
    n = parts(docs.sparkSession)
    shares = [i / n for i in range(1, n)] or [0.5]
    found, lacking = docs.agg(F.percentile_approx("doc_id", shares, 10 * n), F.count_if(F.col("doc_id").isNull())).first()
    cuts = sorted(set(found or []))
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    firsts = F.array(*[F.lit(b[0]).cast("long") for b in blocks if b]).cast("array<bigint>")
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]).cast("array<bigint>") for b in blocks]).cast("array<array<bigint>>")
    coarse = F.size(F.filter(firsts, lambda x: x <= F.col("doc_id")))
    fine = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(F.filter(F.get(table, coarse - 1), lambda x: x <= F.col("doc_id"))))
    bucket, sentinel = fresh(docs, "__bucket"), fresh(docs, "__sentinel")
    none, head = F.col("doc_id").isNull(), _head(F.col("text"))
    heads = sorted(set(docs.where(none).agg(F.percentile_approx(head, shares, 10 * n)).first()[0] or [])) if lacking else []
    by_head = F.size(F.filter(F.array(*[F.lit(x) for x in heads]).cast("array<bigint>"), lambda x: x <= head))
    ranged = docs.withColumn(bucket, F.when(none, -1 - by_head).otherwise(fine))
    # at most one entry for each range: the ranges that have rows, and each one's largest id, or else the hash of its least text
    largest = sorted(((r[0], r[1]) for r in ranged.where(~none).groupBy(bucket).agg(F.max("doc_id")).collect()), reverse=True)
    if lacking:
        largest += sorted(((r[0], r[1]) for r in ranged.where(none).groupBy(bucket).agg(F.min(F.coalesce("text", F.lit(""))).alias("t")).select(bucket, F.xxhash64("t")).collect()), reverse=True)
    before = {b: largest[i - 1][0] for i, (b, _) in enumerate(largest)}
    of = F.create_map(*[F.lit(x) for b, top in largest for x in (b, top)]).cast("map<int,bigint>") if largest else F.lit(None).cast("map<int,bigint>")
    to = F.create_map(*[F.lit(x) for b in before for x in (b, before[b])]).cast("map<int,int>") if before else F.lit(None).cast("map<int,int>")
    own = F.struct(F.col(bucket).cast("int").alias("b"), F.lit(False).alias("s"))
    sent = F.struct(to[F.col(bucket).cast("int")].alias("b"), F.lit(True).alias("s"))
    at = fresh(ranged, "__at")
    first = F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = ranged.withColumn(at, F.explode(F.when(first == of[F.col(bucket).cast("int")], F.array(own, sent)).otherwise(F.array(own))))
    dealt = dealt.withColumn(bucket, F.col(at)["b"]).withColumn(sentinel, F.col(at)["s"]).drop(at)
    window = W.partitionBy(bucket).orderBy(sentinel, F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    out = dealt.select("*", *[F.lead(c).over(window).alias(prefix + c) for c in columns])
    return out.where(~F.col(sentinel)).drop(bucket, sentinel)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, with their likeness.

    The last third of a text is replaced by the beginning of the next document's. Null
    texts count as empty. A single document is its own neighbour; repeated ids follow
    each other by text; extra columns are dropped; an empty table gives an empty one.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chained = with_next(texts, ["text"])  # texts alone are shuffled: a tree is quicker made again than moved
    k = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) AS int))"), F.col("next_text").substr(F.lit(1), k))
    full = trees(chained.withColumn("edited", edited), tree="text", edited_tree="edited", next_tree="next_text")
    return full.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("tree")).alias("fingerprint"), printed(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        changed_sections(F.col("tree"), F.col("edited_tree")).alias("edited_sections"),
    )
