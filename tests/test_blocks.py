"""Block search against plain sums, and that no search makes a table of all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest

from lumenta import queries
from lumenta.operators import blocks, search


def table(rows, group=None):
    ids, maps = zip(*rows, strict=True)
    columns = {"id": pa.array(ids, pa.int64()), "t": pa.array([list(m) for m in maps], pa.list_(pa.int32())), "x": pa.array([list(m.values()) for m in maps], pa.list_(pa.float64()))}
    return pa.table(columns | ({} if group is None else {"group": pa.array(group, pa.string())}))


def plain(query, docs, k, positive=False, shared=False, groups=None):
    scored = []
    for d, m in docs:
        s = sum(w * m[t] for t, w in query.items() if t in m)
        s = float(blocks.rounded(np.array([s]))[0])
        if not (positive and s <= 0) and not (shared and not set(m) & set(query)):
            scored.append((not math.isnan(s), -s if s == s else 0, d))
    kept, seen = [], set()
    for _, s, d in sorted(scored):
        g = groups[d] if groups else d
        if g not in seen:
            seen.add(g)
            kept.append(d)
    return kept[:k]


@pytest.mark.parametrize("cells", [1 << 20, 64])
@pytest.mark.parametrize(("positive", "shared", "grouped"), [(False, False, False), (True, False, False), (False, True, False), (False, True, True)])
def test_blocks_against_plain_sums(monkeypatch, cells, positive, shared, grouped):
    """Negative, equal, zero and infinite values, copies, and queries with too few documents."""
    monkeypatch.setattr(blocks, "CELLS", cells)
    rng = np.random.default_rng(11)
    draw = lambda n, size: {int(t): float(rng.choice([-1, -0.5, 0, 0.5, 1, 2])) for t in rng.choice(n, size, replace=False)}
    docs = [(i, draw(20, rng.integers(1, 6))) for i in rng.permutation(120).tolist()]
    docs += [(1000 - i, {3: 2.0, 4: 1.0}) for i in range(60)] + [(500, {5: math.inf}), (501, {6: math.nan, 7: 1.0})]
    asked = [(q, draw(24, 4)) for q in range(14)] + [(20, {3: 1.0}), (21, {5: 1.0, 9: 1.0}), (22, {6: 2.0}), (23, {23: 1.0})]
    groups = {d: "abcde"[d % 5] for d, _ in docs}
    held = blocks._Blocks(table(asked, [None] * len(asked) if grouped else None), 7, positive, shared, False)
    for lo in range(0, len(docs), 50):
        part = docs[lo : lo + 50]
        held.take(table(part, [groups[d] for d, _ in part] if grouped else None).to_batches()[0])
    got = {}
    for r in pa.Table.from_batches(list(held.results())).to_pylist():
        got.setdefault(r["qid"], []).append(r["doc_id"])
        assert not grouped or r["group"] == groups[r["doc_id"]]
    for q, m in asked:
        assert got.get(q, []) == plain(m, docs, 7, positive, shared, groups if grouped else None)


def test_several_groups_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, int(t), float(rng.uniform(-1, 1))) for i in range(80) for t in rng.choice(12, 4, replace=False)]
    e = spark.createDataFrame(rows, "doc_id long, term int, value double")
    q = e.where("doc_id < 9").selectExpr("doc_id AS qid", "term", "value AS weight")
    want = sorted(map(tuple, search.brute(e, q, 6).collect()))
    monkeypatch.setattr(blocks, "GROUP", 8)
    assert sorted(map(tuple, search.brute(e, q, 6).collect())) == want and len(want) == 54


def test_marks(spark):
    e = spark.createDataFrame([(d, t, 1.0 + d) for d in range(6) for t in (0, 1)] + [(9, 5, 1.0)], "doc_id long, term int, value double")
    q = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "qid long, term int, weight double")
    marks = spark.createDataFrame([(d, d % 3) for d in range(6)] + [(9, 1)], "doc_id long, mark long")
    wanted = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "qid long, mark long")
    got = sorted((r.qid, r.doc_id, r.score) for r in blocks.best(e, q, 10, marks=marks, wanted=wanted).collect())
    assert got == [(0, 1, 2.0), (0, 4, 5.0), (0, 9, 0.0), (1, 0, 1.0), (1, 2, 3.0), (1, 3, 4.0), (1, 5, 6.0)]


NO_PAIRS = ["brute_topk", "inverted_topk", "inverted_top100", "maxscore_topk", "dedupe_topk", "dedupe_topk_padded", "score_threshold", "sq_topk_8bit", "sq_topk_16bit", "filter_include_topk", "filter_exclude_topk", "idmap_topk", "recall_at_k", "store_roundtrip_topk", "index_include_topk", "index_maxscore_topk", "idmap_seismic_store_topk", "doc_lex_topk"]


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_table_of_pairs(spark, name):
    """Before, every pair of a query and a document that share a term was aggregated, shuffled and ranked."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert not [line for line in plan.splitlines() if "Aggregate [qid#" in line and "doc_id#" in line.partition("], [")[0]]


@pytest.mark.parametrize("name", ["maxscore_topk", "index_maxscore_topk"])
def test_maxscore_steps_make_no_pairs(spark, monkeypatch, name):
    """Before, each head of a list was scored with every query on the way to the threshold, and an index's rows were made again for each step."""
    plans, kept = {}, search.scratch
    monkeypatch.setattr(search, "scratch", lambda df, step: plans.update({step: df._jdf.queryExecution().optimizedPlan().toString()}) or kept(df, step))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in plans["theta"] and "array_sort(collect_list" not in plans["heads"]
    assert not [line for plan in plans.values() for line in plan.splitlines() if "Aggregate [qid#" in line and "doc_id#" in line.partition("], [")[0]]
