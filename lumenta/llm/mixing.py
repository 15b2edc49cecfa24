"""Mixing sources to target weights.

Words are summed for each source, each source gets a target, and target / size is
its repetition rate. A document is emitted floor(rate) times, and once more if a
number in [0, 1) drawn from a hash of its id is below the rate's fraction, so the
same input always gives the same mix, on any cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenta.llm.common import WORD, fresh, stored

#: Up to so many sources the table of targets is broadcast (under 10 MB); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Keys to which one source's rows are dealt in the joined case.
SALT = 64


def words_in(text: str | F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row (source, source_size, target) for each source of sized (source, size).

    Weights go to the sources in code-point order, null last, and repeat. A source's
    target is its weight's part of share * all sizes, at most cap * its size; what is
    cut off goes to the others by weight. That is the level at which the sum of
    min(cap * size, level * weight) is the total, found by a running sum over the
    sources in the order in which they reach their caps.
    """
    w = F.array(*[F.lit(x) for x in weights])
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = totals.select("*", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("nth"))
    weighted = by_name.select("source", "source_size", "nth", F.element_at(w, (F.col("nth") % len(weights) + 1).cast("int")).cast("double").alias("weight"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "nth")
    running = weighted.select(
        "*",
        F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open_weight"),
        F.sum("source_size").over(W.partitionBy()).alias("total"),
    )
    level = (F.lit(float(share)) * F.col("total") - F.lit(float(cap)) * F.col("capped")) / F.col("open_weight")
    tried = running.select("*", level.alias("level")).select("*", (F.col("level") * F.col("weight") <= F.lit(float(cap)) * F.col("source_size")).alias("fits"))
    final = tried.select("*", F.max(F.when(F.col("fits"), F.col("level"))).over(W.partitionBy()).alias("settled"))
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("settled") * F.col("weight"), F.lit(float("inf"))))
    return final.select("source", "source_size", target.alias("target"))


def draw(doc_id: F.Column, seed: str) -> F.Column:
    """A number in [0, 1) for each id: 13 hex digits of an MD5, exact as a double."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs plus size, source_size, target and copies; clashing names in docs get out of the way.

    Null or empty texts have size 0; a null source is a source of its own; sources
    without words have target 0 and no copies; repeated rows share their id's draw; an
    empty table gives an empty one.
    """
    own = {c: fresh(docs, f"__{c}") for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")}
    kept = docs.withColumnsRenamed(own)
    sized = kept.withColumn("size", words_in("text"))
    targets = stored(source_targets(sized.select("source", "size"), weights, share, cap).select(F.col("source").alias("__of"), "source_size", "target"), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("__of")))
    else:
        salted = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
        joined = sized.withColumn("__salt_of", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(
            salted, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__salt_of") == F.col("__salt"))
        ).drop("__salt", "__salt_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("__of")


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as its rate says."""
    own = {c: fresh(docs, f"__{c}") for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")}
    rows = plan(docs, **options).where(F.col("copies") > 0)
    n = fresh(rows, "__copy")
    rows = rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
