"""Vectors that arrive as a stream: appended to a table, searched before they are indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenta.operators import search, topk
from lumenta.sources import vectors as sources


def append(stream: DataFrame, path: str, checkpoint: str, dim: int, **options: object) -> StreamingQuery:
    """Starts to append the rows (doc_id, indices, values) of a stream to the table at path."""
    valid = sources.validated(stream, dim).select("doc_id", "indices", "values")
    return valid.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def with_tail(indexed: DataFrame, spark: SparkSession, tail: str, queries: DataFrame, k: int) -> DataFrame:
    """Results of an index joined with an exact search over the appended rows that it does not have."""
    fresh = sources.entries(spark.read.parquet(tail))
    found = search.inverted(fresh, queries, k)
    both = indexed.select("qid", "doc_id", "score").where("doc_id >= 0").unionByName(found.select("qid", "doc_id", "score"))
    return topk.top_k(both.groupBy("qid", "doc_id").agg({"score": "max"}).withColumnRenamed("max(score)", "score"), k)
