"""Registered queries of the retrieval engine, over embeddings and documents.

The vectors are the positive components of embeddings; the query batch are those of
every row whose id is divisible by 100, against all rows. Clustered queries keep 100
postings of a term in 10 clusters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.functions import vectors as expressions
from lumenta.functions.quantize import Quantizer
from lumenta.operators import clusters, idmap, postings, score, search, topk
from lumenta.oracle import SQL
from lumenta.plans import store
from lumenta.plans.index import Index, Selector, index_factory
from lumenta.scratch import scratch, shared_dir
from lumenta.sources import vectors as sources
from lumenta.types import SearchParameters

DIM, K, EVERY, LAM, BETA, ALPHA, CUT = 64, 10, 100, 100, 10, 0.4, 3
Q8, Q16 = Quantizer(8, 0.0, 0.6), Quantizer(16, 0.0, 0.6)


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return sources.positive_components(spark.read.parquet(f"{sf}/embeddings.parquet"))


def batch(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"), "term", F.col("value").alias("weight"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "label")


def ids_of(spark: SparkSession, sf: str, condition: str) -> DataFrame:
    return labels(spark, sf).where(condition).select(F.col("doc_id").alias("id"))


def vectors_to_postings(spark: SparkSession, sf: str) -> DataFrame:
    return postings.transpose(embeddings(spark, sf))


def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return e.agg(F.countDistinct("doc_id").alias("n_vectors"), F.count("*").alias("nnz"), (F.max("term") + 1).cast("int").alias("dim"))


def densify(spark: SparkSession, sf: str) -> DataFrame:
    dense = sources.rows(embeddings(spark, sf)).select("doc_id", expressions.dense(F.col("indices"), F.col("values"), DIM).alias("d"))
    return dense.select("doc_id", F.posexplode("d").alias("term", "value"))


def row_dot(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's inner product with its own dense form, and the place of its largest value."""
    r = sources.rows(embeddings(spark, sf)).withColumn("d", expressions.dense(F.col("indices"), F.col("values"), DIM))
    return r.select("doc_id", F.round(expressions.dot_dense(F.col("indices"), F.col("values"), F.col("d")), 6).alias("dot"), expressions.argmax(F.col("d")).alias("argmax"))


def integer_dot(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf).withColumn("value", Q16.encode(F.col("value")))
    r = sources.rows(e).withColumn("d", F.transform(expressions.dense(F.col("indices"), F.col("values"), DIM), lambda x: x.cast("bigint")))
    return r.select("doc_id", expressions.dot_codes(F.col("indices"), F.col("values"), F.col("d")).alias("dot"))


def term_max_scores(spark: SparkSession, sf: str) -> DataFrame:
    return postings.term_stats(postings.transpose(embeddings(spark, sf)))


def postings_lambda(spark: SparkSession, sf: str) -> DataFrame:
    return postings.pruned(postings.transpose(embeddings(spark, sf)), LAM)


def query_cut(spark: SparkSession, sf: str) -> DataFrame:
    return postings.query_cut(batch(embeddings(spark, sf)), CUT)


def brute_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return search.brute(e, batch(e), K)


def brute_topk_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Among the vectors of one label, with pads where there are fewer than 100."""
    e = embeddings(spark, sf)
    q = batch(e)
    return topk.padded(search.brute(score.included(e, ids_of(spark, sf, "label = 3")), q, 100), q, 100)


def inverted_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return search.inverted(e, batch(e), K)


def inverted_top100(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return search.inverted(e, batch(e), 100)


def maxscore_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return search.maxscore(e, postings.term_stats(e), batch(e), K)


def dedupe_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return search.best_groups(e, batch(e), labels(spark, sf), "label", 5)


def dedupe_topk_padded(spark: SparkSession, sf: str) -> DataFrame:
    """One result for each label; there are fewer labels than places."""
    e = embeddings(spark, sf)
    return search.best_groups(e, batch(e), labels(spark, sf), "label", 15, pad=True)


def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return search.thresholds(e, batch(e), K)


def encoded(q: Quantizer) -> Callable:
    return lambda spark, sf: embeddings(spark, sf).withColumn("code", q.encode(F.col("value"))).select("doc_id", "term", "code")


def sq_decode(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(Q8)(spark, sf).select("doc_id", "term", F.round(Q8.decode(F.col("code")), 9).alias("value"))


def quantized_topk(q: Quantizer) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        codes = embeddings(spark, sf).withColumn("value", q.encode(F.col("value")))
        return search.quantized(codes, batch(codes), q, q, K)

    return run


def lists_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = embeddings(spark, sf)
    return e, postings.pruned(postings.transpose(e), LAM)


def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.centroids(lists_of(spark, sf)[1], BETA)


def cluster_assign(spark: SparkSession, sf: str) -> DataFrame:
    e, lists = lists_of(spark, sf)
    return clusters.assigned(lists, e, BETA)


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_assign(spark, sf).groupBy("term", "cluster_id").agg(F.count("*").alias("n"))


def cluster_summary(alpha: float) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e, lists = lists_of(spark, sf)
        return clusters.summaries(clusters.assigned(lists, e, BETA), e, alpha)

    return run


def built(spark: SparkSession, sf: str, alpha: float = ALPHA) -> tuple[dict[str, DataFrame], DataFrame]:
    e, lists = lists_of(spark, sf)
    members = scratch(clusters.assigned(lists, e, BETA), "members")
    return {"vectors": e, "members": members, "summaries": scratch(clusters.summaries(members, e, alpha), "summaries")}, batch(e)


def summary_scores(spark: SparkSession, sf: str) -> DataFrame:
    index, q = built(spark, sf)
    return clusters.summary_scores(postings.query_cut(q, CUT), q, index["summaries"]).withColumn("s_score", F.round("s_score", 6))


def clustered(mode: str, heap_factor: float = 1.0, condition: str | None = None) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        index, q = built(spark, sf)
        docs = None if condition is None else labels(spark, sf).where(condition).select("doc_id")
        return search.clustered(index, q, K, SearchParameters(CUT, heap_factor, mode), docs)

    return run


def clustered_sq(mode: str, heap_factor: float = 1.0) -> Callable:
    """Lists, clusters, summaries and queries all of 8-bit codes."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = embeddings(spark, sf).withColumn("value", Q8.encode(F.col("value")))
        members = scratch(clusters.assigned(postings.pruned(postings.transpose(e), LAM), e, BETA), "members")
        index = {"vectors": e, "members": members, "summaries": scratch(clusters.summaries(members, e, ALPHA), "summaries")}
        found = search.clustered(index, batch(e), K, SearchParameters(CUT, heap_factor, mode), integer=True)
        return found.withColumn("score", F.round(Q8.decode_dot(F.col("score"), Q8), topk.DIGITS))

    return run


def filter_topk(exclude: bool) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = embeddings(spark, sf)
        ids = ids_of(spark, sf, "label IN (1, 3, 5)")
        return search.inverted((score.excluded if exclude else score.included)(e, ids), batch(e), K)

    return run


def exact_match_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    ids = ids_of(spark, sf, "vec_id % 50 = 7 AND vec_id < 500")
    q = batch(e)
    return topk.padded(search.exact(e, q, ids, K), q, K)


def idmap_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    ids = labels(spark, sf).select(F.col("doc_id").alias("internal_id"), (1000 + 3 * F.col("doc_id")).alias("external_id"))
    wanted = ids.where("external_id % 2 = 0").select(F.col("external_id").alias("id"))
    found = search.inverted(score.included(e, idmap.to_internal(wanted, ids)), batch(e), K)
    return idmap.to_external(found, ids)


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    index, q = built(spark, sf)
    found = search.clustered(index, q, K, SearchParameters(CUT, mode="exhaustive"))
    return search.recall(found, search.inverted(index["vectors"], q, K))


def store_roundtrip_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return saved(index_factory(spark, DIM, "inverted").add(sources.rows(e)).build()).search(query_rows(e), K)


def saved(index: Index) -> Index:
    """index, stored and loaded again."""
    path = f"{shared_dir(index.spark)}/index-{uuid.uuid4().hex}"
    store.save(index, path)
    return store.load(index.spark, path)


def query_rows(e: DataFrame) -> DataFrame:
    return sources.rows(batch(e).withColumnRenamed("weight", "value"), "qid")


def factory_seismic_topk(kind: str) -> Callable:
    """An index made from a description, from the vectors to the results."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = embeddings(spark, sf)
        index = index_factory(spark, DIM, f"{kind}|lambda={LAM}|beta={BETA}|alpha={ALPHA}").add(sources.rows(e)).build()
        return saved(index).search(query_rows(e), K, SearchParameters(CUT))

    return run


def idmap_seismic_store_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with ids of their own, added in two parts, built, stored and searched so widely that the answer is exact."""
    e = embeddings(spark, sf)
    rows = sources.rows(e).withColumn("doc_id", 1000 + 3 * F.col("doc_id"))
    index = index_factory(spark, DIM, f"idmap,seismic,lambda=0|beta={BETA}|alpha=1").add_with_ids(rows.where("doc_id % 2 = 0")).add_with_ids(rows.where("doc_id % 2 = 1")).build()
    return saved(index).search(query_rows(e), K, SearchParameters(DIM))


def index_maxscore_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The index's vectors are written first: bounds, heads, threshold and search each read them."""
    e = embeddings(spark, sf)
    return index_factory(spark, DIM, "inverted").add(scratch(sources.rows(e), "rows")).build().search(query_rows(e), K, SearchParameters(prune=True))


def index_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """An include filter of no more ids than results: the index answers exactly."""
    e = embeddings(spark, sf)
    index = index_factory(spark, DIM, f"seismic,lambda={LAM}|beta={BETA}|alpha={ALPHA}").add(sources.rows(e)).build()
    return index.search(query_rows(e), K, select=Selector(ids_of(spark, sf, "vec_id % 50 = 7 AND vec_id < 500")))


def index_include_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    index = index_factory(spark, DIM, "brutal").add(sources.rows(e))
    return index.search(query_rows(e), K, select=Selector(ids_of(spark, sf, "label IN (1, 3, 5)")))


def doc_lex_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = sources.lexical(spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "qid"), "qid", "text")
    docs = sources.lexical(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", only=q)
    return search.inverted(docs, q.withColumnRenamed("value", "weight"), K)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vectors_to_postings": vectors_to_postings,
    "vector_stats": vector_stats,
    "densify": densify,
    "row_dot": row_dot,
    "integer_dot": integer_dot,
    "term_max_scores": term_max_scores,
    "postings_lambda": postings_lambda,
    "query_cut": query_cut,
    "brute_topk": brute_topk,
    "brute_topk_padded": brute_topk_padded,
    "inverted_topk": inverted_topk,
    "inverted_top100": inverted_top100,
    "maxscore_topk": maxscore_topk,
    "dedupe_topk": dedupe_topk,
    "dedupe_topk_padded": dedupe_topk_padded,
    "score_threshold": score_threshold,
    "sq_encode_8bit": encoded(Q8),
    "sq_encode_16bit": encoded(Q16),
    "sq_decode": sq_decode,
    "sq_topk_8bit": quantized_topk(Q8),
    "sq_topk_16bit": quantized_topk(Q16),
    "cluster_centroids": cluster_centroids,
    "cluster_assign": cluster_assign,
    "cluster_sizes": cluster_sizes,
    "cluster_summary_max": cluster_summary(1.0),
    "cluster_summary_alpha": cluster_summary(ALPHA),
    "summary_scores": summary_scores,
    "clustered_exhaustive_topk": clustered("exhaustive"),
    "clustered_setwise_topk": clustered("setwise"),
    "clustered_setwise_filter_topk": clustered("setwise", 1.2, "label NOT IN (1, 3, 5)"),
    "clustered_sequential_topk": clustered("sequential"),
    "clustered_sq_topk": clustered_sq("setwise"),
    "clustered_sq_sequential_topk": clustered_sq("sequential"),
    "filter_include_topk": filter_topk(False),
    "filter_exclude_topk": filter_topk(True),
    "exact_match_topk": exact_match_topk,
    "idmap_topk": idmap_topk,
    "recall_at_k": recall_at_k,
    "store_roundtrip_topk": store_roundtrip_topk,
    "index_include_topk": index_include_topk,
    "index_maxscore_topk": index_maxscore_topk,
    "index_exact_topk": index_exact_topk,
    "factory_seismic_topk": factory_seismic_topk("seismic,"),
    "factory_seismic_sq_topk": factory_seismic_topk("seismic_sq,quantizer=8bit|vmin=0|vmax=0.6"),
    "idmap_seismic_store_topk": idmap_seismic_store_topk,
    "doc_lex_topk": doc_lex_topk,
}
