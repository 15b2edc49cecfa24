"""Small inputs with known answers."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenta import queries
from lumenta.functions import vectors as expressions
from lumenta.functions.quantize import Quantizer
from lumenta.operators import clusters, idmap, postings, score, search, topk
from lumenta.plans import store
from lumenta.plans.factory import parse
from lumenta.plans.index import Selector, index_factory
from lumenta.sources import csr_file
from lumenta.sources import vectors as sources
from lumenta.streaming import ingest
from lumenta.types import ClusterParameters, SearchParameters


@pytest.fixture
def docs(spark):
    def make(*maps, key="doc_id", ids=None):
        data = [((ids or range(len(maps)))[i], [int(t) for t in m], [float(v) for v in m.values()]) for i, m in enumerate(maps)]
        return spark.createDataFrame(data, f"{key} long, indices array<int>, values array<float>")

    return make


def hits(df):
    rows = sorted(df.collect(), key=lambda r: (r.qid, r["rank"]))
    return [r.doc_id for r in rows], [round(r.score, 4) for r in rows]


def found(spark, docs, kind, maps, query, k, dim=8, params=None, select=None):
    index = index_factory(spark, dim, kind).add(docs(*maps))
    index = index if kind == "brutal" else index.build()
    return hits(index.search(docs(*query, key="qid"), k, params, select))


# fixed values: small inputs whose answers are known
MAPS = [{0: 1.0, 1: 0.5}, {0: 0.8, 2: 0.6}, {1: 0.9, 3: 0.7}]
SIX = [{0: 1.0, 1: 0.5}, {0: 0.9}, {1: 0.8, 2: 0.3}, {2: 0.7}, {3: 0.6}, {0: 0.1, 3: 0.4}]


def test_inverted(spark, docs):
    assert found(spark, docs, "inverted", MAPS, [{0: 1.0, 1: 0.8}], 3) == ([0, 1, 2], [1.4, 0.8, 0.72])
    assert found(spark, docs, "inverted", [{0: 0.3}, {0: 1.0}, {0: 0.5}], [{0: 1}], 3)[0] == [1, 2, 0]
    assert found(spark, docs, "inverted", [{0: 1.0, 1: 0.5}], [{3: 1}], 1) == ([-1], [-1.0])
    assert found(spark, docs, "inverted", [{0: 1.0}, {0: 0.5}], [{0: 1}], 5)[0] == [0, 1, -1, -1, -1]
    assert found(spark, docs, "inverted", [{0: 1.0, 1: 0.5}, {2: 0.8, 3: 0.6}], [{0: 1}, {2: 1}], 1)[0] == [0, 1]


def test_brute_keeps_zero_and_negative_scores(spark, docs):
    assert found(spark, docs, "brutal", [{0: -1.0}, {1: 1.0}, {0: 2.0}], [{0: 1}], 4) == ([2, 1, 0, -1], [2.0, 0.0, -1.0, -1.0])


def test_unbuilt_and_empty_indexes_pad(spark, docs):
    q = docs({0: 1}, key="qid")
    for kind in ("inverted", "seismic", "brutal"):
        assert hits(index_factory(spark, 8, kind).search(q, 2))[0] == [-1, -1]
    assert hits(index_factory(spark, 8, "inverted").add(docs({0: 1})).search(q, 2))[0] == [-1, -1]
    with pytest.raises(NotImplementedError):
        index_factory(spark, 8, "brutal").build()


@pytest.mark.parametrize("kind", ["seismic", "seismic_sq"])
@pytest.mark.parametrize("mode", ["exhaustive", "setwise", "sequential"])
def test_clustered(spark, docs, kind, mode):
    p = lambda cut, hf: SearchParameters(cut, hf, mode)
    few = [{0: 0.1}, {0: 0.2}, {0: 0.3}, {0: 0.4}]
    assert found(spark, docs, f"{kind},lambda=2|beta=1|alpha=.5", few, [{0: 1}], 4, params=p(5, 1))[0] == [3, 2, -1, -1]
    assert found(spark, docs, f"{kind},lambda=10|beta=2|alpha=.5", [{i: 1.0} for i in range(4)], [{0: 0.1, 1: 0.5, 2: 0.9}], 1, params=p(1, 1))[0] == [2]
    ids, scores = found(spark, docs, f"{kind},lambda=10|beta=2|alpha=.5", SIX, [{0: 1, 1: 0.8, 2: 0.5}], 6, params=p(5, 1000))
    assert ids == [0, 1, 2, 3, 5, -1] and np.allclose(scores, [1.4, 0.9, 0.79, 0.35, 0.1, -1], atol=0.01)


def test_selectors(spark, docs):
    maps = [{0: 0.3}, {0: 1.0}, {0: 0.5}, {0: 0.8}]
    for kind in ("seismic", "inverted", "brutal"):
        assert found(spark, docs, kind, maps, [{0: 1}], 2, select=Selector([1, 3]))[0] == [1, 3]
        assert found(spark, docs, kind, maps, [{0: 1}], 3, select=~Selector([1]))[0] == [3, 2, 0]
        assert found(spark, docs, kind, maps, [{0: 1}], 1, select=Selector([0, 2, 2]))[0] == [2]
        assert found(spark, docs, kind, maps, [{0: 1}], 2, select=Selector([]))[0] == [-1, -1]
    assert found(spark, docs, "seismic", [{2: 3}, {3: 7}], [{0: 10}], 2, select=Selector([0, 1])) == ([0, 1], [0.0, 0.0])


def test_external_ids(spark, docs):
    index = index_factory(spark, 8, "idmap,seismic,lambda=10|beta=2|alpha=1")
    with pytest.raises(ValueError):
        index.add(docs({0: 1}))
    maps = [{0: 1, 1: 0.5}, {0: 0.3, 1: 0.2}, {0: 0.8, 1: 0.4}]
    index = index.add_with_ids(docs(*maps[:2], ids=[1000, 2000])).add_with_ids(docs(maps[2], ids=[3000])).build()
    q = docs({0: 1, 1: 1}, key="qid")
    assert hits(index.search(q, 4)) == ([1000, 3000, 2000, -1], [1.5, 1.2, 0.5, -1.0])
    assert hits(index.search(q, 3, select=Selector([1000, 2000])))[0] == [1000, 2000, -1]
    assert hits(index.search(q, 3, select=Selector([999])))[0] == [-1, -1, -1]
    assert hits(index.search(q, 3, select=~Selector([1000])))[0] == [3000, 2000, -1]
    with pytest.raises(ValueError):
        index.add_with_ids(docs({0: 1}, ids=[1000]))
    with pytest.raises(NotImplementedError):
        index_factory(spark, 8, "inverted").add_with_ids(docs({0: 1}))


def test_demo(spark, docs):
    maps = [{0: 1, 10: 0.5, 50: 0.8}, {5: 2, 15: 1.5, 60: 0.3}, {0: 0.8, 5: 1.2, 20: 0.3}, {10: 1, 30: 0.7, 70: 0.9}, {0: 0.6, 15: 0.4, 50: 1.1}]
    queries = [{0: 1, 50: 0.5}, {5: 1.5, 15: 0.8}]
    assert found(spark, docs, "inverted", maps, queries, 3, 100) == ([0, 4, 2, 1, 2, 4], [1.4, 1.15, 0.8, 4.2, 1.8, 0.32])
    index = index_factory(spark, 100, "inverted").add(docs(*maps)).build()
    scores, ids = index.search_arrays(np.array([0, 2, 4]), np.array([0, 50, 5, 15]), np.array([1, 0.5, 1.5, 0.8]), 3)
    assert ids.tolist() == [[0, 4, 2], [1, 2, 4]] and np.allclose(scores[0], [1.4, 1.15, 0.8])


def entries(docs, *maps):
    return sources.entries(docs(*maps)).withColumn("value", F.col("value").cast("double"))


def test_maxscore_and_setwise_agree_with_full_search(spark, docs):
    rng = np.random.default_rng(42)
    maps = [{int(t): float(rng.uniform(0.1, 1)) for t in rng.choice(40, 8, replace=False)} for _ in range(120)]
    queries = [{int(t): float(rng.uniform(0.1, 1)) for t in rng.choice(40, 6, replace=False)} for _ in range(6)]
    e, q = entries(docs, *maps), sources.entries(docs(*queries, key="qid"), "qid").withColumnRenamed("value", "weight")
    want = hits(search.inverted(e, q, 5))
    assert hits(search.maxscore(e, postings.term_stats(e), q, 5)) == want
    members = clusters.assigned(e, e, 4)
    assert sorted((r.term, r.doc_id) for r in members.collect()) == sorted((r.term, r.doc_id) for r in e.collect())
    index = {"vectors": e, "members": members, "summaries": clusters.summaries(members, e, 1.0)}
    for mode in ("exhaustive", "setwise", "sequential"):
        assert hits(search.clustered(index, q, 5, SearchParameters(50, 1.0, mode))) == want
    assert {r.recall for r in search.recall(search.inverted(e, q, 5), search.inverted(e, q, 5)).collect()} == {1.0}


@pytest.mark.parametrize("negative", [False, True])
def test_brute_completes_queries_that_lack_results(spark, docs, negative):
    rng = np.random.default_rng(3)
    maps = [{int(t): float(rng.choice([-1, 1] if negative else [1]) * rng.uniform(0.1, 1)) for t in rng.choice(30, 3, replace=False)} for _ in range(60)]
    queries = [{int(t): float(rng.uniform(0.1, 1)) for t in rng.choice(40, 2, replace=False)} for _ in range(8)] + [{39: 1.0}]
    e, q = entries(docs, *maps), sources.entries(docs(*queries, key="qid"), "qid").withColumnRenamed("value", "weight")
    got = search.brute(e, q, 12).collect()
    for i, query in enumerate(queries):
        scored = sorted((-round(sum(w * np.float32(m.get(t, 0)) for t, w in {t: np.float32(w) for t, w in query.items()}.items()), 6) + 0.0, d) for d, m in enumerate(maps))
        own = sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])
        assert [r.doc_id for r in own] == [d for _, d in scored[:12]] and np.allclose([r.score for r in own], [-s for s, _ in scored[:12]], atol=2e-6)


def by_hand(lists, summaries, vectors, query, k, cut, factor):
    """The scan of one query, list by list: lists {term: {cluster: docs}}, summaries {(term, cluster): {term: value}}."""
    terms = list(query) if len(query) <= cut else sorted(query, key=lambda t: (-query[t], t))[:cut]
    dot = lambda a: sum(w * a.get(t, 0) for t, w in query.items())
    heap, skipped = {}, 0
    for n, t in enumerate(terms):
        order = sorted(lists.get(t, {}))
        worth = {c: dot(summaries.get((t, c), {})) for c in order}
        if n == 0:
            order.sort(key=lambda c: (-round(worth[c], 9), c))
        for c in order:
            if len(heap) >= k and worth[c] * factor < sorted(heap.values())[-k]:
                skipped += 1
                if n == 0:
                    break
                continue
            heap |= {d: dot(vectors[d]) for d in lists[t][c]}
    return sorted(heap, key=lambda d: (-round(heap[d], 6), d))[:k], skipped


@pytest.mark.parametrize(("cut", "factor", "codes"), [(3, 1.0, False), (3, 0.7, False), (6, 0.9, False), (3, 0.9, True)])
def test_sequential_against_a_plain_scan(spark, docs, cut, factor, codes):
    """Where pruning happens: pages of clusters are skipped, in the same order and by the same threshold."""
    rng = np.random.default_rng(7)
    draw = (lambda: int(rng.integers(1, 256))) if codes else (lambda: float(np.float32(rng.uniform(0.1, 1))))
    maps = [{int(t): draw() for t in rng.choice(25, 6, replace=False)} for _ in range(150)]
    queries = [{int(t): draw() for t in rng.permutation(25)[:5]} for _ in range(6)]
    e = entries(docs, *maps)
    q = docs(*queries, key="qid").select("qid", F.posexplode(F.arrays_zip("indices", "values")).alias("pos", "e")).select("qid", "pos", F.col("e.indices").alias("term"), F.col("e.values").cast("double").alias("weight"))
    if codes:
        e, q = e.withColumn("value", F.col("value").cast("long")), q.withColumn("weight", F.col("weight").cast("long"))
    members = clusters.assigned(postings.pruned(e, 20), e, 5).cache()
    summaries = clusters.summaries(members, e, 0.4).cache()
    lists, tops, skipped = {}, {}, 0
    for r in members.collect():
        lists.setdefault(r.term, {}).setdefault(r.cluster_id, []).append(r.doc_id)
    for r in summaries.collect():
        tops.setdefault((r.term, r.cluster_id), {})[r.s_term] = r.s_value
    index = {"vectors": e, "members": members, "summaries": summaries}
    got = search.clustered(index, q, 4, SearchParameters(cut, factor, "sequential"), integer=codes).collect()
    for i, query in enumerate(queries):
        want, n = by_hand(lists, tops, maps, query, 4, cut, factor)
        skipped += n
        assert [r.doc_id for r in sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])] == want
    assert skipped > 10


def test_pruned_inverted_index(spark, docs):
    plain = found(spark, docs, "inverted", SIX, [{0: 1, 1: 0.8, 2: 0.5}], 3)
    assert found(spark, docs, "inverted", SIX, [{0: 1, 1: 0.8, 2: 0.5}], 3, params=SearchParameters(prune=True)) == plain
    with pytest.raises(ValueError):
        found(spark, docs, "inverted", SIX, [{0: -1}], 3, params=SearchParameters(prune=True))


def test_lambda_and_cut(spark, docs):
    lists = entries(docs, {0: 1}, {0: 4}, {0: 2}, {0: 3})
    for lam, want in ((2, [1, 3]), (0, [0, 1, 2, 3]), (10, [0, 1, 2, 3])):
        assert sorted(r.doc_id for r in postings.pruned(lists, lam).collect()) == want
    q = spark.createDataFrame([(0, i, w) for i, w in enumerate([1.0, 5.0, 3.0, 2.0, 4.0])], "qid long, term int, weight double")
    assert [r.term for r in postings.query_cut(q, 3).orderBy("place").collect()] == [1, 4, 2]
    q = spark.createDataFrame([(0, p, t, w) for p, (t, w) in enumerate([(10, 3.0), (30, 1.0), (20, 2.0)])], "qid long, pos int, term int, weight double")
    assert [[r.term for r in postings.query_cut(q, k).orderBy("place").collect()] for k in (3, 9, 2)] == [[10, 30, 20], [10, 30, 20], [10, 20]]
    assert {r.term: r.max_value for r in postings.term_stats(entries(docs, {0: 0.5}, {0: 3.75}, {1: -2.0})).collect()} == {0: 3.75, 1: 0.0}


def test_summaries(spark, docs):
    e = entries(docs, {0: 1, 1: 2}, {0: 3, 1: 1})
    members = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "term int, cluster_id int, doc_id long")
    assert {r.s_term: r.s_value for r in clusters.summaries(members, e).collect()} == {0: 3.0, 1: 2.0}
    e = entries(docs, {0: 10, 1: 5, 2: 3, 3: 2})
    one = spark.createDataFrame([(0, 0, 0)], "term int, cluster_id int, doc_id long")
    assert {r.s_term for r in clusters.summaries(one, e, 0.5).collect()} == {0}
    assert {r.s_term for r in clusters.summaries(one, entries(docs, {0: -1, 1: -2}), 0.5).collect()} == {0, 1}


def test_clusters_partition_each_list(spark, docs):
    e = entries(docs, {0: 1, 1: 0.5}, {0: 0.8, 1: 0.6, 2: 0.7}, {1: 0.9, 2: 0.4})
    kept = postings.pruned(e, 2)
    got = clusters.assigned(kept, e, 2).collect()
    assert sorted((r.term, r.doc_id) for r in got) == sorted((r.term, r.doc_id) for r in kept.collect())
    assert {t: len({r.cluster_id for r in got if r.term == t}) for t in range(3)} == {0: 2, 1: 2, 2: 2}
    nine = entries(docs, *[{0: i + 1.0} for i in range(9)])
    assert clusters.centroids(nine, 0).count() == 3 and clusters.centroids(nine.where("doc_id < 2"), 10).count() == 2


@pytest.mark.parametrize(("rows", "heads"), [(256, 64), (3, 2)])
def test_nearest_centroids_against_all_products(monkeypatch, rows, heads):
    monkeypatch.setattr(clusters, "ROWS", rows)
    monkeypatch.setattr(clusters, "HEADS", heads)
    rng = np.random.default_rng(5)
    draw = lambda n: [dict(sorted((int(t), float(rng.integers(-3, 4))) for t in rng.choice(12, rng.integers(0, 6), replace=False))) for _ in range(n)]
    a, b = draw(20), draw(7)
    table = lambda maps, before: pa.table({f"{before}t": pa.array([list(m) for m in maps], pa.list_(pa.int64())), f"{before}x": pa.array([list(m.values()) for m in maps], pa.list_(pa.float64()))})
    order = rng.permutation(7).tolist()
    left = table(a, "").append_column("term", pa.array([4] * 20, pa.int32())).append_column("doc_id", pa.array(range(20), pa.int64()))
    right = table([b[i] for i in order], "head_").append_column("head_cluster_id", pa.array(order, pa.int32()))
    got = clusters._nearest(left, right).to_pylist()
    dots = [[sum(x * h.get(t, 0) for t, x in m.items()) for h in b] for m in a]
    assert got == [{"term": 4, "cluster_id": d.index(max(d)), "doc_id": i} for i, d in enumerate(dots)]
    assert clusters._nearest(left.slice(0, 0), right).num_rows == 0


def test_lists_dealt_to_groups(spark, docs, monkeypatch):
    rng = np.random.default_rng(6)
    e = entries(docs, *[{int(t): float(rng.uniform(0.1, 1)) for t in rng.choice(6, 3, replace=False)} for _ in range(50)])
    want = sorted(map(tuple, clusters.assigned(e, e, 3).select("term", "cluster_id", "doc_id").collect()))
    monkeypatch.setattr(clusters, "GROUP", 4)
    assert sorted(map(tuple, clusters.assigned(e, e, 3).select("term", "cluster_id", "doc_id").collect())) == want


def test_quantizer(spark):
    q8 = Quantizer(8)
    row = spark.range(1).select(*[q8.encode(F.lit(v)).alias(str(v)) for v in (0.5, -0.5, 1.5)]).first()
    assert tuple(row) == (128, 0, 255) and (q8.bytes_per_value, Quantizer(16).bytes_per_value) == (1, 2)
    dot = lambda s, a, b: spark.range(1).select(a.decode_dot(F.lit(s), b)).first()[0]
    assert math.isclose(dot(65025, q8, q8), 1) and math.isclose(dot(65025, Quantizer(8, 0, 2), Quantizer(8, 0, 4)), 8)
    assert math.isclose(dot(65535**2, Quantizer(16, 0, 10), Quantizer(16, 0, 5)), 50)
    assert math.isclose(spark.range(1).select(Quantizer(8, 1, 3).decode(F.lit(255))).first()[0], 3)
    with pytest.raises(ValueError):
        Quantizer(8, 1, 1)


def test_expressions(spark, docs):
    r = docs({0: 1000, 2: 2000}).select(expressions.dense(F.col("indices"), F.col("values"), 3).alias("d")).first()
    assert r.d == [1000, 0, 2000]
    codes = spark.createDataFrame([([0, 1], [65535, 65535])], "i array<int>, c array<int>").select(expressions.dot_codes(F.col("i"), F.col("c"), F.col("c"))).first()[0]
    assert codes == 8589672450
    assert docs({0: 1, 1: 2, 2: 3}).select(expressions.dot_dense(F.col("indices"), F.col("values"), F.array(*map(F.lit, (5, 0, 7, 0))))).first()[0] == 26
    assert spark.range(1).select(expressions.argmax(F.array(F.lit(1), F.lit(5), F.lit(5)))).first()[0] == 1


def test_validation(spark, docs):
    for rows in ([(0, [0, 1], [1.0])], [(0, [9], [1.0])], [(0, [-1], [1.0])], [(0, [1, 1], [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "doc_id long, indices array<int>, values array<float>")
        with pytest.raises(Exception, match="term|size"):
            sources.validated(df, 8).collect()
    df = spark.createDataFrame([(0, [1, 1], [1.0, 2.0])], "doc_id long, indices array<int>, values array<float>")
    assert sources.validated(df, 8, "sum").first()["values"] == [3.0]
    for bad in (lambda: sources.validated(df, 0), lambda: topk.top_k(df, 0), lambda: SearchParameters(cut=0), lambda: ClusterParameters(beta=-2), lambda: SearchParameters(mode="x"), lambda: SearchParameters(heap_factor=-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        sources.from_csr(spark, np.array([0, 2]), np.array([1]), np.array([1.0]))
    assert sources.from_csr(spark, np.array([0]), np.array([]), np.array([])).count() == 0


def test_factory():
    for bad in (None, "", "nothing", "seismic,lambda=", "idmap"):
        with pytest.raises(ValueError):
            parse(8, bad)
    d = parse(8, " idmap , seismic_sq , quantizer=16bit | vmax = 3 | odd | lambda=7")
    assert d.external_ids and d.clusters == ClusterParameters(7, 5, 0.5) and d.quantizer == Quantizer(16, 0, 3)
    assert parse(8, "seismic_sq,quantizer=4bit").quantizer.bits == 8
    assert ClusterParameters().resolved(1_000_000) == ClusterParameters(500, 50, 0.4) and ClusterParameters().resolved(10).lam == 160


def test_dedupe_and_thresholds(spark):
    s = spark.createDataFrame([(0, 1, 5.0), (0, 2, 3.0), (0, 3, 7.0), (0, 4, 9.0)], "qid long, doc_id long, score double")
    g = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "doc_id long, g string")
    assert hits(search.deduplicated(s, g, "g", 2)) == ([4, 1], [9.0, 5.0])
    asked = spark.createDataFrame([(0,), (0,), (1,)], "qid long")
    assert hits(search.deduplicated(s, g, "g", 3, asked)) == ([4, 1, -1, -1, -1, -1], [9.0, 5.0, -1.0, -1.0, -1.0, -1.0])
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 5.0, 3.0, 0.5, 4.0])], "qid long, doc_id long, score double")
    assert topk.thresholds(s, 3).first().theta == 3.0 and topk.thresholds(s, 6).count() == 0


@pytest.mark.parametrize("kind", ["brutal", "inverted", "seismic,lambda=10|beta=2|alpha=.5", "seismic_sq,vmax=2", "idmap,inverted"])
def test_store(spark, docs, kind, tmp_path):
    index = index_factory(spark, 8, kind)
    index = index.add_with_ids(docs(*SIX)) if kind.startswith("idmap") else index.add(docs(*SIX))
    index = index if kind == "brutal" else index.build()
    store.save(index, str(tmp_path / "i"))
    back = store.load(spark, str(tmp_path / "i"))
    q = docs({0: 1, 1: 0.8}, {3: 1}, key="qid")
    assert back.about == index.about and back.num_vectors() == 6 and back.element_size() == (1 if "sq" in kind else 4)
    assert hits(back.search(q, 4)) == hits(index.search(q, 4))
    spark.createDataFrame([('{"kind": "none", "tables": [], "vectors": 0, "ids": false}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "i/manifest"))
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "i"))


def test_saved_vectors_are_scored_where_they_lie(spark, docs, tmp_path):
    store.save(index_factory(spark, 8, "brutal").add(docs(*SIX)), str(tmp_path / "i"), buckets=3)
    back = store.load(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.8)], "qid long, term int, weight double")
    scored = score.products(back.entries(), q)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert {r.doc_id: round(r.score, 4) for r in scored.collect()} == {0: 1.4, 1: 0.9, 2: 0.64, 5: 0.1}


def test_csr_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csr_file, "ROWS", 2)
    path = str(tmp_path / "x.csr")
    csr_file.write_csr(path, 8, np.array([0, 2, 2, 3, 5, 6]), np.array([0, 1, 4, 2, 3, 7]), np.array([1, 2, 3, 4, 5, 6.5]))
    got = {r.doc_id: (r.indices, r["values"]) for r in csr_file.read_csr(spark, path).collect()}
    assert got == {0: ([0, 1], [1, 2]), 1: ([], []), 2: ([4], [3]), 3: ([2, 3], [4, 5]), 4: ([7], [6.5])}


def test_cut_off_csr_files(spark, tmp_path):
    path = tmp_path / "x.csr"
    csr_file.write_csr(str(path), 8, np.array([0, 2]), np.array([0, 1]), np.array([1, 2]))
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        csr_file.read_csr(spark, str(path)).collect()


def test_streamed_tail(spark, docs, tmp_path):
    docs({0: 1.0}, {0: 3.0}, ids=[10, 11]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, indices array<int>, values array<float>").parquet(str(tmp_path / "in"))
    ingest.append(stream, str(tmp_path / "tail"), str(tmp_path / "check"), 8).awaitTermination()
    index = index_factory(spark, 8, "inverted").add(docs({0: 2.0})).build()
    q = docs({0: 1}, key="qid")
    flat = sources.entries(q, "qid").withColumnRenamed("value", "weight")
    assert hits(ingest.with_tail(index.search(q, 3), spark, str(tmp_path / "tail"), flat, 3)) == ([11, 0, 10], [3.0, 2.0, 1.0])


def test_id_maps(spark):
    m = spark.createDataFrame([(0, 100), (1, 200)], "internal_id long, external_id long")
    ids = spark.createDataFrame([(100,), (100,), (7,)], "id long")
    assert [r.id for r in idmap.to_internal(ids, m).collect()] == [0]
    res = spark.createDataFrame([(0, 1, 1, 2.0), (0, 2, -1, -1.0)], "qid long, rank int, doc_id long, score double")
    assert hits(idmap.to_external(res, m)) == ([200, -1], [2.0, -1.0])
    assert score.small(m).count() == 2


def test_lexical_search_finds_tokens_beyond_the_reference_dimension(spark, tmp_path):
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [a + b + c + d for a in letters[:4] for b in letters for c in letters for d in letters]
    spark.createDataFrame([(1, " ".join(many)), (2, "zebra zebra"), (3, "other zulu")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Zebra"), (8, "zulu aaaa nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in queries.doc_lex_topk(spark, str(tmp_path)).collect())
    one = math.log(2)
    assert len(many) > 65_536
    assert got == [(7, 1, 2, round(math.log(3) * one, 6)), (8, 1, 1, round(one * one, 6)), (8, 2, 3, round(one * one, 6))]


@pytest.mark.parametrize("name", ["integer_dot", "row_dot"])
def test_dense_forms_are_found_once_a_row(spark, name):
    """Before, the lambda over a row's values held the whole dense form, which was made anew for each of them."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and "map_from_arrays" not in plan.partition("zip_with")[2].partition(" AS dot")[0]
