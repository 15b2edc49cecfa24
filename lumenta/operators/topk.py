"""Ranking, padding and deduplication of scored pairs (qid, doc_id, score).

Float scores are ranked as rounded to six places, ties by id, so that results do not
depend on the order of summation. Ranks are filtered below the window's shuffle, so
each task sends at most k rows a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenta.types import PAD_ID, PAD_SCORE, check_k

DIGITS = 6


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", DIGITS))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score), rank from 1."""
    check_k(k)
    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "doc_id", "score")


def padded(top: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows for each qid of queries, filled with the pad id and score."""
    slots = queries.select("qid").distinct().select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(top, ["qid", "rank"], "left").select(
        "qid", "rank", F.coalesce("doc_id", F.lit(PAD_ID).cast("long")).alias("doc_id"), F.coalesce("score", F.lit(PAD_SCORE)).alias("score")
    )


def best_of_each(scores: DataFrame, group: str) -> DataFrame:
    """The best pair of each (qid, group): one result for each group value."""
    best = F.max_by(F.struct("doc_id", "score"), F.struct("score", -F.col("doc_id")))
    return scores.groupBy("qid", group).agg(best.alias("b")).select("qid", group, "b.doc_id", "b.score")


def thresholds(scores: DataFrame, k: int) -> DataFrame:
    """(qid, theta): the k-th best score; queries with fewer pairs have none."""
    return top_k(scores, k).where(F.col("rank") == k).select("qid", F.col("score").alias("theta"))
