"""Top-k searches. Queries are (qid, term, weight), results (qid, rank, doc_id, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenta.operators import blocks, clusters, postings, score, topk
from lumenta.scratch import scratch
from lumenta.types import SearchParameters


def brute(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Over all documents, also those of score 0 or below."""
    return topk.top_k(blocks.best(vectors, queries, k), k)


def inverted(lists: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Over documents that share a term, and only with a score above 0."""
    return topk.top_k(blocks.best(lists, queries, k, positive=True), k)


def thresholds(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, theta): the k-th best score of the documents that share a term; queries with fewer have none."""
    return topk.thresholds(blocks.best(vectors, queries, k, shared=True), k)


def maxscore(lists: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The answer of inverted(), with fewer documents scored; weights must not be negative."""
    wanted = needed(lists, stats, queries, k).withColumnRenamed("term", "mark")
    return topk.top_k(blocks.best(lists, queries, k, positive=True, wanted=wanted), k)


def needed(lists: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, term): each query's essential terms.

    Full scores of the k best documents of each query's strongest term give a threshold
    that the k-th result reaches; those documents are the head of the term's list, whatever
    the query's weight, and the term is the mark by which they meet the query in blocks.
    Terms whose bounds together stay below it are not essential: a document that has only
    such terms cannot be a result. So candidates come from essential terms.
    """
    bound = queries.join(stats, "term").withColumn("bound", F.col("weight") * F.col("max_value"))
    rising = W.partitionBy("qid").orderBy("bound", "term")
    ranked = bound.select("qid", "term", "weight", "bound", F.sum("bound").over(rising).alias("up_to"), F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "term")).alias("nth"))
    ranked = scratch(ranked, "bounds")
    heads = scratch(postings.pruned(lists.select("term", "doc_id", "value"), k).select("doc_id", F.col("term").alias("mark")), "heads")
    seeds = ranked.where("nth = 1").select("qid", F.col("term").alias("mark"))
    theta = scratch(topk.thresholds(blocks.best(score.included(lists, heads.select(F.col("doc_id").alias("id"))), queries, k, marks=heads, wanted=seeds), k), "theta")
    return ranked.join(theta, "qid", "left").where(F.col("up_to") >= F.coalesce("theta", F.lit(0.0)) - 1e-5).select("qid", "term")


def essential(lists: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, doc_id) that have one of their query's essential terms; there may be nearly as many as pairs."""
    return needed(lists, stats, queries, k).join(lists, "term").select("qid", "doc_id").distinct()


def exact(vectors: DataFrame, queries: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Exactly the documents of ids (id) that exist, also with score 0."""
    docs = score.included(vectors, ids)
    pairs = queries.select("qid").distinct().crossJoin(score.small(docs.select("doc_id").distinct()))
    return topk.top_k(topk.rounded(score.of_candidates(docs, queries, pairs)), k)


def quantized(codes: DataFrame, queries: DataFrame, quantizer: object, query_quantizer: object, k: int) -> DataFrame:
    """inverted() on integer codes; scores are decoded last."""
    scored = blocks.best(codes, queries, k, positive=True, integer=True)
    return topk.top_k(scored, k).withColumn("score", F.round(quantizer.decode_dot(F.col("score"), query_quantizer), topk.DIGITS))


def best_groups(vectors: DataFrame, queries: DataFrame, groups: DataFrame, group: str, k: int, pad: bool = False) -> DataFrame:
    """deduplicated() over all documents that share a term with a query, without their pairs."""
    own = groups.select("doc_id", F.col(group).alias("group"))
    best = topk.best_of_each(blocks.best(vectors, queries, k, shared=True, groups=own), "group")
    top = topk.top_k(best.select("qid", "doc_id", "score"), k)
    return topk.padded(top, queries, k) if pad else top


def deduplicated(scores: DataFrame, groups: DataFrame, group: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The k best groups (doc_id, group), each by its best document; filled with pads for each qid of queries, if given."""
    best = topk.best_of_each(scores.join(groups, "doc_id"), group)
    top = topk.top_k(best.select("qid", "doc_id", "score"), k)
    return top if queries is None else topk.padded(top, queries, k)


def clustered(index: dict[str, DataFrame], queries: DataFrame, k: int, params: SearchParameters, docs: DataFrame | None = None, integer: bool = False) -> DataFrame:
    """Approximate search over clustered lists; index has vectors, members and summaries.

    docs, if given, is what a filter leaves of the documents: it holds before thresholds
    are found. Candidates are scored with the whole query, so scores may be 0 or less.
    """
    if params.mode == "sequential":
        return sequential(index, queries, k, params, docs, integer)
    queries = queries.drop("pos")
    cut = postings.query_cut(queries, params.cut)
    members = index["members"] if docs is None else index["members"].join(docs.select("doc_id"), "doc_id", "left_semi")
    if params.mode == "exhaustive":
        marks, wanted = members.select("doc_id", F.col("term").alias("mark")), cut.select("qid", F.col("term").alias("mark"))
    else:  # both are small next to the index, and written so that the threshold is found once
        scored = scratch(clusters.summary_scores(cut, queries, index["summaries"]), "summary-scores")
        marks, wanted = members.select("doc_id", _cluster()), scratch(promising(scored, cut, members, index["vectors"], queries, k, params.heap_factor, integer), "wanted")
    return topk.top_k(blocks.best(index["vectors"], queries, k, integer=integer, marks=marks, wanted=wanted), k)


def _cluster() -> Column:
    """One number for a cluster of a term."""
    return (F.shiftleft(F.col("term").cast("long"), 32) + F.col("cluster_id")).alias("mark")


def surviving(scored: DataFrame, cut: DataFrame, members: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, heap_factor: float, integer: bool = False) -> DataFrame:
    """Candidates (qid, doc_id), documents of promising clusters; there may be nearly as many as pairs."""
    wanted = promising(scored, cut, members, vectors, queries, k, heap_factor, integer)
    return wanted.join(members.select("doc_id", _cluster()), "mark").select("qid", "doc_id").distinct()


def promising(scored: DataFrame, cut: DataFrame, members: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, heap_factor: float, integer: bool = False) -> DataFrame:
    """Clusters (qid, mark) by a threshold found in the heaviest term's list.

    Its clusters are taken by falling summary score until they hold k documents; the k-th
    best score among these is the threshold, and clusters of any cut term stay whose
    summary score times heap_factor reaches it.
    """
    first = scored.join(cut.where("place = 1").select("qid", "term"), ["qid", "term"])
    sizes = members.groupBy("term", "cluster_id").agg(F.count("*").alias("n"))
    order = W.partitionBy("qid").orderBy(F.desc("s_score"), "cluster_id").rowsBetween(W.unboundedPreceding, -1)
    seeds = first.join(sizes, ["term", "cluster_id"]).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k)
    seeds = scratch(seeds.select("qid", _cluster()), "seeds")
    theta = topk.thresholds(blocks.best(vectors, queries, k, integer=integer, marks=members.select("doc_id", _cluster()), wanted=seeds), k)
    kept = scored.join(theta, "qid", "left").where(F.col("theta").isNull() | (F.col("s_score") * F.lit(float(heap_factor)) >= F.col("theta")))
    return kept.select("qid", _cluster()).unionByName(seeds).distinct()


def sequential(index: dict[str, DataFrame], queries: DataFrame, k: int, params: SearchParameters, docs: DataFrame | None = None, integer: bool = False) -> DataFrame:
    """One list after the other with a moving threshold, one query a task.

    The first list's clusters are taken by falling summary score, and the first that
    cannot reach the k-th best so far ends it; later lists go in stored order, and such
    clusters are skipped. Lists go by falling weight; those of a query of at most cut
    terms go in the order of pos, if queries have it. What a query's task holds is its
    cut terms' clusters.
    """
    members = index["members"] if docs is None else index["members"].join(docs.select("doc_id"), "doc_id", "left_semi")
    cut = postings.query_cut(queries, params.cut)
    scored = clusters.summary_scores(cut, queries, index["summaries"])
    pairs = scored.join(members, ["term", "cluster_id"]).select("qid", "term", "cluster_id", "s_score", "doc_id")
    full = score.of_candidates(index["vectors"], queries, pairs.select("qid", "doc_id").distinct(), integer=integer)
    rows = pairs.join(full, ["qid", "doc_id"]).join(cut.select("qid", "term", "place"), ["qid", "term"])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        seen: dict[int, float] = {}
        for place, of_term in f.sort_values(["place", "cluster_id", "doc_id"]).groupby("place"):
            groups = [(s, c, g) for (c, s), g in of_term.groupby(["cluster_id", "s_score"])]
            if place == 1:
                groups.sort(key=lambda x: (-x[0], x[1]))
            for s, _, g in groups:
                if len(seen) >= k and s * params.heap_factor < np.partition(np.fromiter(seen.values(), float), -k)[-k]:
                    if place == 1:
                        break
                    continue
                seen.update(zip(g["doc_id"].tolist(), g["score"].astype(float).tolist(), strict=True))
        return pd.DataFrame({"qid": int(f["qid"].iloc[0]), "doc_id": list(seen), "score": list(seen.values())})

    return topk.top_k(topk.rounded(rows.groupBy("qid").applyInPandas(run, "qid long, doc_id long, score double")), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall): the part of truth's documents that found has."""
    hits = truth.select("qid", "doc_id").join(found.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
