"""Inner products as joins.

Entries and query terms meet on the term; products are summed for each (qid, doc_id).
Entries stored in buckets of doc_id are summed where they lie. The query side is
broadcast only after its size has been looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query terms that are broadcast at most (some 24 bytes each); larger batches are joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def products(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of all pairs that share a term."""
    joined = entries.join(small(queries.select("qid", F.col("term").alias("q_term"), "weight")), F.col("term") == F.col("q_term"))
    return joined.groupBy("qid", "doc_id").agg(F.sum(F.col("value").cast("double") * F.col("weight").cast("double")).alias("score"))


def integer_products(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """The same on codes, exact in 64 bits."""
    joined = entries.join(small(queries.select("qid", F.col("term").alias("q_term"), "weight")), F.col("term") == F.col("q_term"))
    return joined.groupBy("qid", "doc_id").agg(F.sum(F.col("value").cast("bigint") * F.col("weight").cast("bigint")).alias("score"))


def of_candidates(entries: DataFrame, queries: DataFrame, candidates: DataFrame, zeros: bool = True, integer: bool = False) -> DataFrame:
    """Full scores of the candidate pairs (qid, doc_id) alone; with zeros, also of those that share no term."""
    docs = entries.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = (integer_products if integer else products)(docs, queries)
    kept = candidates.join(scored, ["qid", "doc_id"], "left" if zeros else "inner")
    return kept.select("qid", "doc_id", F.coalesce("score", F.lit(0)).alias("score") if zeros else F.col("score"))


def included(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ids (id); repeated ids count once."""
    return df.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")


def excluded(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")
