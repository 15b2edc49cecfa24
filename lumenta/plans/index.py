"""Indexes as immutable snapshots of tables.

add() gives a new index with more vectors; build() gives one with its search tables.
Vectors added after build() are found by exact search alone until it is built again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.functions.quantize import Quantizer
from lumenta.operators import clusters, idmap, postings, score, search, topk
from lumenta.plans.factory import Description, parse
from lumenta.scratch import scratch
from lumenta.sources import vectors as sources
from lumenta.types import PAD_ID, PAD_SCORE, SearchParameters, check_k


@dataclass(frozen=True)
class Selector:
    """Ids to include, or to exclude. ids: a list or a DataFrame (id)."""

    ids: Any
    exclude: bool = False

    def __invert__(self) -> Selector:
        return replace(self, exclude=not self.exclude)

    def frame(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.ids, DataFrame):
            return self.ids.select(F.col("id").cast("long")).distinct()
        return spark.createDataFrame([(int(x),) for x in dict.fromkeys(self.ids)], "id long")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    about: Description
    vectors: DataFrame | None = None  # rows (doc_id, indices, values), doc_id internal
    ids: DataFrame | None = None  # (internal_id, external_id)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return self.about.dim

    @property
    def kind(self) -> str:
        return self.about.kind

    def num_vectors(self) -> int:
        return 0 if self.vectors is None else self.vectors.count()

    def element_size(self) -> int:
        """Bytes of a stored value."""
        return self.about.quantizer.bytes_per_value if self.about.quantizer else 4

    def add(self, rows: DataFrame, on_duplicate: str = "error") -> Index:
        """With the rows (doc_id, indices, values) too; their ids must be new."""
        if self.about.external_ids:
            raise ValueError("this index needs add_with_ids")
        new = sources.validated(rows, self.dim, on_duplicate).select("doc_id", "indices", "values")
        return replace(self, vectors=new if self.vectors is None else self.vectors.unionByName(new))

    def add_with_ids(self, rows: DataFrame, on_duplicate: str = "error") -> Index:
        """With rows whose doc_id is an external id; internal ids go on from those there are."""
        if not self.about.external_ids:
            raise NotImplementedError("only idmap indexes keep external ids")
        from pyspark.sql import Window as W

        base = 0 if self.ids is None else (self.ids.agg(F.max("internal_id")).first()[0] or 0) + 1
        # numbers within ranges of external ids, plus the ranges' offsets: no window spans the batch
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.select(F.col("doc_id").alias("external_id"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("part"))
        offsets = ranged.groupBy("part").count().select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("offset"))
        nth = F.row_number().over(W.partitionBy("part").orderBy("external_id")) - 1
        ids = ranged.withColumn("nth", nth).join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("nth") + base).cast("long").alias("internal_id"), "external_id")
        ids = idmap.checked(ids if self.ids is None else self.ids.unionByName(ids))
        own = ids.where(F.col("internal_id") >= base).withColumnRenamed("external_id", "doc_id")
        new = rows.join(own, "doc_id").select(F.col("internal_id").alias("doc_id"), "indices", "values")
        new = sources.validated(new, self.dim, on_duplicate).select("doc_id", "indices", "values")
        return replace(self, vectors=new if self.vectors is None else self.vectors.unionByName(new), ids=ids)

    def entries(self) -> DataFrame:
        """(doc_id, term, value), as codes if the index is quantised."""
        e = sources.entries(self.vectors).withColumn("value", F.col("value").cast("double"))
        return e.withColumn("value", self.about.quantizer.encode(F.col("value"))) if self.about.quantizer else e

    def build(self) -> Index:
        if self.kind == "brutal":
            raise NotImplementedError("an exhaustive index is not built")
        if self.vectors is None:
            return self
        entries = self.entries()
        lists = postings.transpose(entries)
        if self.kind == "inverted":
            return replace(self, tables={"postings": lists, "stats": postings.term_stats(lists)})
        p = self.about.clusters.resolved(self.num_vectors())
        kept = postings.pruned(lists, p.lam)
        members = scratch(clusters.assigned(kept, entries, p.beta), "members")
        return replace(self, tables={"members": members, "summaries": scratch(clusters.summaries(members, entries, p.alpha), "summaries")})

    def cached(self) -> Index:
        return replace(self, vectors=self.vectors.cache() if self.vectors is not None else None, tables={k: t.cache() for k, t in self.tables.items()})

    def search(self, queries: DataFrame, k: int, params: SearchParameters | None = None, select: Selector | None = None, pad: bool = True) -> DataFrame:
        """(qid, rank, doc_id, score) of rows queries (qid, indices, values).

        An include selector of no more than k ids is answered exactly. An index without
        vectors, or not yet built, gives pads alone.
        """
        check_k(k)
        params = params or SearchParameters()
        ordered = queries.select("qid", F.posexplode(F.arrays_zip("indices", "values")).alias("pos", "e"))
        q = ordered.select("qid", "pos", F.col("e.indices").alias("term"), F.col("e.values").cast("double").alias("weight"))
        found = self._found(q, k, params, select)
        if found is not None and self.ids is not None:
            found = idmap.to_external(found, self.ids)
        if found is None:
            found = queries.select("qid").where("false").selectExpr("qid", "0 AS rank", "qid AS doc_id", "0D AS score")
        return topk.padded(found, queries, k) if pad else found

    def _found(self, q: DataFrame, k: int, params: SearchParameters, select: Selector | None) -> DataFrame | None:
        if self.vectors is None:
            return None
        entries, quantizer = self.entries(), self.about.quantizer
        query_quantizer = quantizer
        if quantizer:
            if params.vmax is not None:
                query_quantizer = Quantizer(quantizer.bits, params.vmin or 0.0, params.vmax)
            q = q.withColumn("weight", query_quantizer.encode(F.col("weight")))
        decode = lambda df: df.withColumn("score", F.round(quantizer.decode_dot(F.col("score"), query_quantizer), topk.DIGITS)) if quantizer else df
        docs = None
        if select is not None:
            ids = select.frame(self.spark)
            ids = idmap.to_internal(ids, self.ids) if self.ids is not None else ids
            if not select.exclude and select.frame(self.spark).limit(k + 1).count() <= k:
                return decode(search.exact(entries, q, ids, k))
            entries = (score.excluded if select.exclude else score.included)(entries, ids)
            docs = entries.select("doc_id").distinct()
        if self.kind == "brutal":
            return search.brute(entries, q, k)
        if not self.tables:
            return None
        if self.kind == "inverted":
            lists = self.tables["postings"] if docs is None else self.tables["postings"].join(docs, "doc_id", "left_semi")
            if params.prune:
                if not q.where("weight < 0").isEmpty():
                    raise ValueError("pruning needs query weights of 0 or more")
                return search.maxscore(lists, self.tables["stats"], q, k)
            return search.inverted(lists, q, k)
        return decode(search.clustered(self.tables | {"vectors": entries}, q, k, params, docs, integer=quantizer is not None))

    def search_arrays(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, k: int, params: SearchParameters | None = None, select: Selector | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, n x k, of a CSR batch of queries that the caller holds."""
        queries = sources.from_csr(self.spark, indptr, indices, values, key="qid")
        n = len(indptr) - 1
        scores, ids = np.full((n, k), PAD_SCORE, np.float32), np.full((n, k), PAD_ID, np.int64)
        for r in self.search(queries, k, params, select, pad=False).toLocalIterator():
            scores[r.qid, r.rank - 1], ids[r.qid, r.rank - 1] = r.score, r.doc_id
        return scores, ids


def index_factory(spark: SparkSession, dim: int, description: str) -> Index:
    return Index(spark, parse(dim, description))
