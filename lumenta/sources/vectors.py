"""Vector tables.

Rows (id, indices, values) are how vectors are stored; entries (id, term, value), one
row for each component, are what the operators join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.operators.score import small
from lumenta.types import MAX_DIM


def entries(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, value) of rows (key, indices, values)."""
    pairs = F.explode(F.arrays_zip("indices", "values"))
    return vectors.select(key, pairs.alias("e")).select(key, F.col("e.indices").alias("term"), F.col("e.values").alias("value"))


def rows(entries_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, indices, values) of entries, terms ascending."""
    held = F.array_sort(F.collect_list(F.struct("term", "value")))
    return entries_.groupBy(key).agg(held.alias("e")).select(key, F.col("e.term").alias("indices"), F.col("e.value").alias("values"))


def validated(vectors: DataFrame, dim: int, on_duplicate: str = "error", key: str = "doc_id") -> DataFrame:
    """Rows whose arrays have equal sizes, whose terms lie in 0..dim-1 and come once.

    With on_duplicate="sum" the values of a repeated term are added; with "error" they,
    like every other fault, raise when the row is read.
    """
    if dim <= 0 or dim > MAX_DIM:
        raise ValueError(f"dim must be in 1..{MAX_DIM}")
    sizes = F.size("indices") == F.size("values")
    inside = F.forall("indices", lambda t: (t >= 0) & (t < dim))
    once = F.size(F.array_distinct("indices")) == F.size("indices")
    checks = [(sizes, "indices and values differ in size"), (inside, "a term is outside the dimension")]
    if on_duplicate == "error":
        checks.append((once, "a term comes twice"))
    fault = F.coalesce(*[F.when(~ok, F.lit(text)) for ok, text in checks])
    good = vectors.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True)))
    if on_duplicate == "sum":
        terms = F.array_sort(F.array_distinct("indices"))
        at = lambda i, t: F.when(F.get("indices", i) == t, F.get("values", i).cast("double")).otherwise(F.lit(0.0))
        total = F.transform(terms, lambda t: F.aggregate(F.sequence(F.lit(0), F.size("indices") - 1), F.lit(0.0), lambda total, i: total + at(i, t)))
        total = F.when(F.size("indices") > 0, total).otherwise(F.array().cast("array<double>"))
        # under other names first: in one select, "indices" would mean the new column
        summed = good.select(key, terms.alias("__terms"), total.cast(vectors.schema["values"].dataType).alias("__sums"))
        good = summed.withColumnsRenamed({"__terms": "indices", "__sums": "values"})
    return good


def from_csr(spark: SparkSession, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, ids: np.ndarray | None = None, key: str = "doc_id") -> DataFrame:
    """Rows of a CSR batch; ids default to 0, 1, ... An indptr of fewer than two entries has no rows."""
    indptr, indices, values = np.asarray(indptr, np.int64), np.asarray(indices, np.int64), np.asarray(values, np.float32)
    if len(indices) != len(values) or (len(indptr) > 1 and indptr[-1] != len(indices)):
        raise ValueError("indptr, indices and values do not fit together")
    n = max(0, len(indptr) - 1)
    ids = np.arange(n) if ids is None else np.asarray(ids)
    if len(ids) != n:
        raise ValueError("one id is needed for each row")
    data = [(int(ids[i]), indices[indptr[i] : indptr[i + 1]].tolist(), values[indptr[i] : indptr[i + 1]].tolist()) for i in range(n)]
    return spark.createDataFrame(data, f"{key} long, indices array<int>, values array<float>")


def positive_components(embeddings: DataFrame) -> DataFrame:
    """Entries of dense embeddings: their positive components."""
    long = embeddings.select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("term", "value"))
    return long.where("value > 0").select("doc_id", "term", F.col("value").cast("double").alias("value"))


def lexical(documents: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """Entries log(1 + tf) of lower-cased a-z tokens, each token its own term: no vocabulary is numbered or bounded.

    With only (term), for a search, other tokens go before they are counted.
    """
    token = F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    tokens = documents.select(F.col(key), token.alias("term"))
    if only is not None:
        tokens = tokens.join(small(only.select("term").distinct()), "term", "left_semi")
    counts = tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return counts.select(key, "term", F.log1p("tf").alias("value"))
