"""Saved indexes: a manifest and one Parquet table each for vectors, ids and search tables.

Vectors are written in buckets of doc_id and read back as such, so that the products of a
document with a query are summed where the document lies, without a shuffle. Search
tables are sorted by term, so that row groups can be skipped. All input and output is
Spark's, so any of its file systems will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.functions.quantize import Quantizer
from lumenta.plans.factory import TYPES, Description
from lumenta.plans.index import Index
from lumenta.types import ClusterParameters

ORDER = {"postings": ["term", "doc_id"], "stats": ["term"], "members": ["term", "cluster_id", "doc_id"], "summaries": ["term", "cluster_id", "s_term"]}


VECTORS = "doc_id BIGINT, indices ARRAY<INT>, values ARRAY<FLOAT>"


def save(index: Index, path: str, mode: str = "errorifexists", buckets: int | None = None) -> None:
    """buckets: how many files of vectors; by default as many as shuffle partitions."""
    buckets = buckets or int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    about = asdict(index.about) | {"tables": sorted(index.tables), "vectors": buckets if index.vectors is not None else 0, "ids": index.ids is not None}
    if index.vectors is not None:
        rows = index.vectors.select("doc_id", F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<float>").alias("values"))
        table = f"saved_{uuid.uuid4().hex}"
        # the path is not the table's, which is dropped at once; its files stay
        rows.repartition(buckets, "doc_id").write.mode(mode).bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", f"{path}/vectors").format("parquet").saveAsTable(table)
        index.spark.sql(f"DROP TABLE {table}")
    if index.ids is not None:
        index.ids.write.mode(mode).parquet(f"{path}/ids")
    for name, table in index.tables.items():
        table.repartitionByRange(*ORDER[name]).sortWithinPartitions(*ORDER[name]).write.mode(mode).parquet(f"{path}/{name}")
    index.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The vectors at path, with Spark told of their buckets."""
    table = f"loaded_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({VECTORS}) USING parquet CLUSTERED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{place}'")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog forgets it, the files and this plan stay
    return out


def load(spark: SparkSession, path: str) -> Index:
    about = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if about["kind"] not in TYPES:
        raise ValueError(f"unknown index type {about['kind']!r}")
    names, vectors, ids = about.pop("tables"), about.pop("vectors"), about.pop("ids")
    about["clusters"] = ClusterParameters(**about["clusters"]) if about["clusters"] else None
    about["quantizer"] = Quantizer(**about["quantizer"]) if about["quantizer"] else None
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(spark, Description(**about), bucketed(spark, f"{path}/vectors", vectors) if vectors else None, read("ids") if ids else None, {n: read(n) for n in names})
