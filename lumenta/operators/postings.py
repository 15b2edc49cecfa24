"""Inverted lists: entries seen by term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def transpose(vectors: DataFrame) -> DataFrame:
    """Postings (term, doc_id, value) of entries."""
    return vectors.select("term", "doc_id", "value")


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, max_value, df): the largest value of each list, at least 0, and its length."""
    return postings.groupBy("term").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("max_value"), F.count("*").alias("df"))


def pruned(postings: DataFrame, lam: int) -> DataFrame:
    """The lam largest postings of each term, ties by id; all of them if lam is 0 or less."""
    if lam <= 0:
        return postings
    order = W.partitionBy("term").orderBy(F.desc("value"), "doc_id")
    return postings.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= lam).drop("__nth")


def query_cut(queries: DataFrame, cut: int) -> DataFrame:
    """The cut heaviest terms of each query, ties by term, with their place from 1.

    If queries have pos, a query of at most cut terms keeps them in that order.
    """
    order = [F.desc("weight"), F.asc("term")]
    if "pos" in queries.columns:
        short = F.count("*").over(W.partitionBy("qid")) <= cut
        queries, order = queries.withColumn("__given", F.when(short, F.col("pos"))), [F.asc("__given"), *order]
    order = W.partitionBy("qid").orderBy(*order)
    return queries.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cut).select("qid", "term", "weight", "place")
