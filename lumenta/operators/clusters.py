"""Clusters within each inverted list, and their summaries.

Centroids are chosen by a portable hash, every other posting goes to the centroid of
largest inner product, and a cluster's summary is the largest value of each of its
members' terms, cut to the shortest head that has the part alpha of its mass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenta.operators.score import small
from lumenta.scratch import scratch

SEED = 42
MODULUS = 2_147_483_647
#: Documents of one group, and centroids beside it; of them, how many rows and centroids are multiplied at once.
GROUP, HELD, ROWS, HEADS = 4096, 2048, 256, 64


def centroids(lists: DataFrame, beta: int) -> DataFrame:
    """(term, cluster_id, doc_id): beta documents of each list, the square root of its length if beta is 0, at least one."""
    mixed = (F.pmod("doc_id", F.lit(MODULUS)) * F.lit(1_103_515_245) + F.col("term").cast("bigint") * 12_345 + SEED) % MODULUS
    nth = F.row_number().over(W.partitionBy("term").orderBy(mixed, "doc_id"))
    ranked = lists.select("term", "doc_id", nth.alias("nth"))
    if beta:  # ranks are cut below the window's shuffle
        kept = ranked.where(F.col("nth") <= max(1, beta))
    else:
        sizes = lists.groupBy("term").agg(F.greatest(F.lit(1), F.floor(F.sqrt(F.count("*").cast("double")))).alias("wanted"))
        kept = ranked.join(sizes, "term").where(F.col("nth") <= F.col("wanted"))
    return kept.select("term", (F.col("nth") - 1).alias("cluster_id"), "doc_id")


def assigned(lists: DataFrame, vectors: DataFrame, beta: int) -> DataFrame:
    """(term, cluster_id, doc_id) of every posting; no overlap counts as 0, ties go to the lowest cluster.

    Pairs are those of a list's postings and centroids: at most lam * beta a term. Terms are
    dealt to parts of about HELD centroids. A document comes to a part once for all of its
    postings there, with its whole vector; documents of a part are dealt to groups of about
    GROUP, each beside all of the part's centroids, and only the best centroid of each
    posting leaves it. Lists and centroids are written first: they are used several times.
    """
    lists = scratch(lists.select("term", "doc_id"), "lists")
    heads = scratch(centroids(lists, beta), "heads")
    n_parts = max(1, -(-heads.count() // HELD))
    part = F.pmod(F.xxhash64("term"), F.lit(n_parts)).cast("int").alias("part")
    others = lists.select("term", "doc_id").join(heads.select("term", "doc_id"), ["term", "doc_id"], "left_anti")
    asked = scratch(others.groupBy("doc_id", part).agg(F.collect_list("term").alias("terms")), "asked")
    sizes = asked.groupBy("part").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    own = vectors.join(lists.select("doc_id").distinct(), "doc_id", "left_semi")
    held = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("term").cast("long").alias("t"), F.col("value").cast("double").alias("x")))).alias("e"))
    rows = held.select("doc_id", F.col("e.t").alias("t"), F.col("e.x").alias("x"))
    dealt = asked.join(sizes, "part").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int"))
    beside = heads.withColumn("part", part).join(sizes, "part").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    a = dealt.join(rows, "doc_id").select("part", "g", "doc_id", "terms", "t", "x")
    b = beside.join(rows, "doc_id").select(*[F.col(c).alias(f"head_{c}") for c in ("part", "g", "term", "cluster_id", "t", "x")])
    best = a.groupBy("part", "g").cogroup(b.groupBy("head_part", "head_g")).applyInArrow(_nearest_of_lists, f"term {lists.schema['term'].dataType.simpleString()}, cluster_id int, doc_id long")
    return heads.unionByName(best)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values begin, with the end of all, and the values."""
    whole = column.combine_chunks()
    lengths = whole.value_lengths().to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(lengths)), whole.flatten().to_numpy(zero_copy_only=False)


def _nearest(postings: pa.Table, heads: pa.Table) -> pa.Table:
    """The cluster of each posting of one term, from the postings' and the centroids' vectors (t, x)."""
    if not postings.num_rows:
        return postings.select(["term"]).append_column("cluster_id", pa.array([], pa.int32())).append_column("doc_id", postings.column("doc_id"))
    terms = pa.ListArray.from_arrays(pa.array(np.arange(postings.num_rows + 1, dtype=np.int32)), postings.column("term").combine_chunks())
    own = pa.repeat(postings.column("term")[0], heads.num_rows)
    return _nearest_of_lists(postings.append_column("terms", terms), heads.append_column("head_term", own))


def _nearest_of_lists(docs: pa.Table, heads: pa.Table) -> pa.Table:
    """The cluster of each of the documents' postings (terms), from their and the centroids' vectors (t, x)."""
    heads = heads.sort_by([("head_term", "ascending"), ("head_cluster_id", "ascending")])
    begin, terms = _flat(docs.column("t"))
    values = _flat(docs.column("x"))[1]
    h_begin, h_terms = _flat(heads.column("head_t"))
    h_values = _flat(heads.column("head_x"))[1]
    p_begin, p_terms = _flat(docs.column("terms"))
    row, p_row = np.repeat(np.arange(docs.num_rows), np.diff(begin)), np.repeat(np.arange(docs.num_rows), np.diff(p_begin))
    by_term = np.lexsort((p_row, p_terms))
    of_list, list_end = np.searchsorted(p_terms[by_term], (h_list := heads.column("head_term").to_numpy())), np.searchsorted(p_terms[by_term], h_list, "right")
    clusters = heads.column("head_cluster_id").to_numpy()
    best, nearest = np.full(len(p_terms), -np.inf), np.zeros(len(p_terms), np.int64)
    for lo in range(0, heads.num_rows, HEADS):
        hi = min(heads.num_rows, lo + HEADS)
        own = slice(h_begin[lo], h_begin[hi])
        known = np.unique(h_terms[own])
        dense = np.zeros((len(known), hi - lo))
        dense[np.searchsorted(known, h_terms[own]), np.repeat(np.arange(hi - lo), np.diff(h_begin[lo : hi + 1]))] = h_values[own]
        at = np.searchsorted(known, terms)
        hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == terms) if len(known) else np.zeros(len(terms), bool)
        at, h_row, h_value = at[hit], row[hit], values[hit]
        edges = np.searchsorted(h_row, np.arange(0, docs.num_rows + ROWS, ROWS))
        starts = lo + np.flatnonzero(np.append(True, h_list[lo + 1 : hi] != h_list[lo : hi - 1]))
        for k, first in enumerate(range(0, docs.num_rows, ROWS)):
            part, n = slice(edges[k], edges[k + 1]), min(ROWS, docs.num_rows - first)
            vectors = np.bincount((h_row[part] - first) * len(known) + at[part], h_value[part], n * len(known)).reshape(n, len(known))
            sim = np.round(vectors @ dense, 9)
            for a, b in zip(starts, [*starts[1:], hi], strict=True):
                mine = by_term[of_list[a] : list_end[a]]
                mine = mine[slice(*np.searchsorted(p_row[mine], (first, first + n)))]
                near = sim[p_row[mine] - first, a - lo : b - lo]
                if len(mine):
                    most = near.argmax(axis=1)
                    value = near[np.arange(len(mine)), most]
                    better = value > best[mine]
                    nearest[mine] = np.where(better, clusters[a + most], nearest[mine])
                    best[mine] = np.where(better, value, best[mine])
    return pa.table({"term": docs.column("terms").combine_chunks().flatten(), "cluster_id": pa.array(nearest, pa.int32()), "doc_id": pa.array(docs.column("doc_id").to_numpy()[p_row], pa.int64())})


def summaries(members: DataFrame, vectors: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(term, cluster_id, s_term, s_value): each cluster's summary.

    Terms are taken by falling value until their sum has the part alpha of all; a summary
    without mass is kept whole.
    """
    own = vectors.select("doc_id", F.col("term").alias("s_term"), "value")
    pooled = members.join(own, "doc_id").groupBy("term", "cluster_id", "s_term").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("s_value"))
    if alpha >= 1:
        return pooled
    cluster = W.partitionBy("term", "cluster_id")
    before = F.coalesce(F.sum("s_value").over(cluster.orderBy(F.desc("s_value"), "s_term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    part = F.try_divide(before, F.sum("s_value").over(cluster))
    return pooled.withColumn("__part", F.round(part, 9)).where(F.coalesce(F.col("__part") < alpha, F.lit(True))).drop("__part")


def summary_scores(cut_queries: DataFrame, queries: DataFrame, summary: DataFrame) -> DataFrame:
    """(qid, term, cluster_id, s_score): the whole query's inner product with each summary of the lists of its cut terms."""
    lists = cut_queries.select("qid", "term").join(summary.select("term", "cluster_id").distinct(), "term")
    # summaries are few beside the index: a query meets their terms where it lies, and its products are summed there
    met = queries.select("qid", F.col("term").alias("s_term"), "weight").repartition("qid").join(small(summary), "s_term")
    hits = met.join(cut_queries.select("qid", "term"), ["qid", "term"], "left_semi")
    scored = hits.groupBy("qid", "term", "cluster_id").agg(F.sum(F.col("s_value") * F.col("weight")).alias("s_score"))
    return lists.join(scored, ["qid", "term", "cluster_id"], "left").select("qid", "term", "cluster_id", F.round(F.coalesce("s_score", F.lit(0.0)), 9).alias("s_score"))
