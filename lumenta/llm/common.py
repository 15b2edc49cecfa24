"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, whatever extra columns came in."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where none is configured."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


@functools.lru_cache
def _own_dir(application: str) -> str:
    """For tests and single machines, where no folder is configured."""
    return f"file://{tempfile.mkdtemp(prefix='lumenta-')}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage is cut and lost executors cost nothing.

    The files stay until the folder is cleaned, since results are lazy and may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def redealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with its long keys computed anew (x ^ 0), for a join with the rows that df was aggregated from.

    Else the join takes over the aggregate's partitioning, and all rows of a frequent key
    meet in one task. So both sides get an exchange of their own, which adaptive execution
    can split.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For str.translate; the same as ascii_lower.
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def crc_of_id(doc_id: object) -> int:
    """The unsigned CRC-32 of a document id as text; 0 for null, as for the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def id_crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


#: Bytes of text in a bucket, about.
BUCKET_BYTES = 64 << 20


def bucketed(df: DataFrame, key: str, name: str, size: int) -> DataFrame:
    """df of about size bytes, written in buckets of key: later groupings and joins by key need no shuffle of it.

    There is one bucket for every 64 MB, and at least as many as shuffle partitions. The
    catalog forgets the table at once; its files stay, as those of stored() do.
    """
    spark = df.sparkSession
    n, table = max(parts(spark), -(-size // BUCKET_BYTES)), f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out
