"""External ids: a table (internal_id, external_id) joined before and after a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.types import PAD_ID


def checked(id_map: DataFrame) -> DataFrame:
    """id_map, or an error if an external id comes twice or is negative."""
    twice = id_map.groupBy("external_id").count().where("count > 1 OR external_id < 0").limit(1).count()
    if twice:
        raise ValueError("external ids must be distinct and not negative")
    return id_map


def to_internal(ids: DataFrame, id_map: DataFrame) -> DataFrame:
    """Internal ids of external ones (id); unknown ones are dropped."""
    return ids.select(F.col("id").alias("external_id")).distinct().join(id_map, "external_id").select(F.col("internal_id").alias("id"))


def to_external(results: DataFrame, id_map: DataFrame) -> DataFrame:
    """results with external doc_ids; pad ids pass through."""
    named = results.join(id_map.select(F.col("internal_id").alias("doc_id"), "external_id"), "doc_id", "left")
    return named.select("qid", "rank", F.coalesce("external_id", F.lit(PAD_ID).cast("long")).alias("doc_id"), "score")
