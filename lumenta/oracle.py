"""The same queries in SQL for an independent engine."""

from __future__ import annotations

VEC = "emb AS (SELECT vec_id AS doc_id, (i - 1)::INT AS term, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE embedding[i] > 0)"
BATCH = "q AS (SELECT doc_id AS qid, term, value AS weight FROM emb WHERE doc_id % 100 = 0)"
BASE = f"WITH {VEC}, {BATCH}"
SCORED = "scored AS (SELECT qid, doc_id, round(sum(value * weight), 6) AS score FROM emb JOIN q USING (term) GROUP BY qid, doc_id)"


def ranked(source: str, k: int = 10, more: str = "") -> str:
    return f"SELECT qid, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {source}{more}) WHERE rank <= {k}"


def padded(top: str, queries: str, k: int = 10) -> str:
    return f"SELECT s.qid, s.rank::INT AS rank, coalesce(t.doc_id, -1)::BIGINT AS doc_id, coalesce(t.score, -1.0)::DOUBLE AS score FROM (SELECT DISTINCT qid, unnest(range(1, {k + 1})) AS rank FROM {queries}) s LEFT JOIN ({top}) t USING (qid, rank)"


def code(value: str, top: int) -> str:
    return f"round(greatest(0.0, least({top}.0, {value} * {top}.0 / 0.6::DOUBLE)))::BIGINT"


def quantized(top: int) -> str:
    e, w = code("value", top), code("weight", top)
    inner = f"SELECT qid, doc_id, sum({e} * {w})::BIGINT AS s FROM emb JOIN q USING (term) GROUP BY qid, doc_id"
    return f"""{BASE}, scored AS ({inner}), best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM scored WHERE s > 0)
SELECT qid, rank::INT AS rank, doc_id, round(s::DOUBLE * (0.6::DOUBLE * 0.6::DOUBLE) / ({top}.0::DOUBLE * {top}.0::DOUBLE), 6) AS score FROM best WHERE rank <= 10"""


LISTS = "lists AS (SELECT term, doc_id, value FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY value DESC, doc_id) AS nth FROM emb) WHERE nth <= 100)"
HEADS = """heads AS (SELECT term, (nth - 1)::INT AS cluster_id, doc_id FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY
  ((doc_id % 2147483647) * 1103515245 + term * 12345 + 42) % 2147483647, doc_id) AS nth FROM lists) WHERE nth <= 10)"""
MEMBERS = """sims AS (SELECT a.doc_id, b.doc_id AS head, round(sum(a.value * b.value), 9) AS sim FROM emb a JOIN emb b USING (term) WHERE b.doc_id IN (SELECT doc_id FROM heads) GROUP BY 1, 2),
tried AS (SELECT l.term, l.doc_id, h.cluster_id, coalesce(s.sim, 0) AS sim FROM lists l JOIN heads h ON l.term = h.term LEFT JOIN sims s ON s.doc_id = l.doc_id AND s.head = h.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM heads x WHERE x.term = l.term AND x.doc_id = l.doc_id)),
members AS (SELECT term, cluster_id, doc_id FROM heads UNION ALL
  SELECT term, cluster_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY term, doc_id ORDER BY sim DESC, cluster_id) AS nth FROM tried) WHERE nth = 1)"""
POOLED = "pooled AS (SELECT m.term, m.cluster_id, e.term AS s_term, greatest(max(e.value), 0.0) AS s_value FROM members m JOIN emb e USING (doc_id) GROUP BY 1, 2, 3)"
SUMMARIES = """parts AS (SELECT *, round(coalesce(sum(s_value) OVER (PARTITION BY term, cluster_id ORDER BY s_value DESC, s_term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  / sum(s_value) OVER (PARTITION BY term, cluster_id), 9) AS part FROM pooled),
summaries AS (SELECT term, cluster_id, s_term, s_value FROM parts WHERE part < 0.4)"""
CUT = "cut AS (SELECT * FROM (SELECT qid, term, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS place FROM q) WHERE place <= 3)"
SUMMED = """summed AS (SELECT c.qid, s.term, s.cluster_id, round(coalesce(sum(s.s_value * q.weight), 0), 9) AS s_score FROM cut c JOIN summaries s ON s.term = c.term
  LEFT JOIN q ON q.qid = c.qid AND q.term = s.s_term GROUP BY 1, 2, 3)"""
PARTS = f"{LISTS}, {HEADS}, {MEMBERS}, {POOLED}, {SUMMARIES}, {CUT}, {SUMMED}, {SCORED}"
BUILT = f"{BASE}, {PARTS}"
CODED = f"WITH {VEC.replace('emb AS', 'raw AS')}, emb AS (SELECT doc_id, term, {code('value', 255)}::DOUBLE AS value FROM raw), {BATCH}, {PARTS}"


def setwise(factor: float, members: str = "members", built: str = BUILT) -> str:
    return f"""{built}, own AS (SELECT * FROM {members}),
sizes AS (SELECT term, cluster_id, count(*) AS n FROM own GROUP BY 1, 2),
firsts AS (SELECT s.*, coalesce(sum(z.n) OVER (PARTITION BY s.qid ORDER BY s.s_score DESC, s.cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM summed s JOIN cut c ON c.qid = s.qid AND c.term = s.term AND c.place = 1 JOIN sizes z ON z.term = s.term AND z.cluster_id = s.cluster_id),
seeds AS (SELECT DISTINCT f.qid, o.doc_id FROM firsts f JOIN own o ON o.term = f.term AND o.cluster_id = f.cluster_id WHERE f.before < 10),
theta AS (SELECT qid, score AS theta FROM (SELECT s.qid, coalesce(c.score, 0) AS score, row_number() OVER (PARTITION BY s.qid ORDER BY coalesce(c.score, 0) DESC, s.doc_id) AS nth
  FROM seeds s LEFT JOIN scored c USING (qid, doc_id)) WHERE nth = 10),
found AS (SELECT s.qid, o.doc_id FROM summed s LEFT JOIN theta t ON t.qid = s.qid JOIN own o ON o.term = s.term AND o.cluster_id = s.cluster_id WHERE t.theta IS NULL OR s.s_score * {factor}::DOUBLE >= t.theta
  UNION SELECT qid, doc_id FROM seeds),
full_ AS (SELECT f.qid, f.doc_id, coalesce(c.score, 0) AS score FROM found f LEFT JOIN scored c USING (qid, doc_id))
{ranked("full_")}"""


EXHAUSTIVE = f"found AS (SELECT DISTINCT c.qid, l.doc_id FROM cut c JOIN lists l USING (term)), full_ AS (SELECT f.qid, f.doc_id, coalesce(s.score, 0) AS score FROM found f LEFT JOIN scored s USING (qid, doc_id))"
INVERTED = f"{BASE}, {SCORED} {ranked('scored', more=' WHERE score > 0')}"
LABELLED = "(SELECT vec_id FROM embeddings WHERE label IN (1, 3, 5))"
LEX = """dt AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY 1, 2),
bt AS (SELECT item_id AS qid, token, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT b.qid, d.doc_id, round(sum(ln(1 + d.tf) * ln(1 + b.tf)), 6) AS score FROM dt d JOIN bt b USING (token) GROUP BY 1, 2)"""
SETWISE_SQ = f"SELECT qid, rank, doc_id, round(score * (0.6::DOUBLE * 0.6::DOUBLE) / (255.0::DOUBLE * 255.0::DOUBLE), 6) AS score FROM ({setwise(1.0, built=CODED)})"
EVERY_LABELLED = "every AS (SELECT x.qid, d.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT qid FROM q) x CROSS JOIN (SELECT DISTINCT doc_id FROM emb WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)) d LEFT JOIN scored s USING (qid, doc_id))"
BY_LABEL = "best AS (SELECT qid, doc_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.qid, e.label ORDER BY s.score DESC, s.doc_id) AS n FROM scored s JOIN embeddings e ON e.vec_id = s.doc_id) WHERE n = 1)"


EXACT = f"{BASE}, {SCORED}, every AS (SELECT x.qid, d.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT qid FROM q) x CROSS JOIN (SELECT DISTINCT doc_id FROM emb WHERE doc_id % 50 = 7 AND doc_id < 500) d LEFT JOIN scored s USING (qid, doc_id)) {padded(ranked('every'), 'q')}"


def with_pads(sql: str, k: int = 10) -> str:
    """sql's results, padded for each query of the batch."""
    return f"WITH {VEC}, {BATCH}, top AS ({sql}) {padded('SELECT * FROM top', 'q', k)}"


SQL: dict[str, str] = {
    "vectors_to_postings": f"WITH {VEC} SELECT term, doc_id, value FROM emb",
    "vector_stats": f"WITH {VEC} SELECT count(DISTINCT doc_id) AS n_vectors, count(*) AS nnz, (max(term) + 1)::INT AS dim FROM emb",
    "densify": "SELECT vec_id AS doc_id, (i - 1)::INT AS term, greatest(embedding[i], 0)::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)",
    "row_dot": f"WITH {VEC}, best AS (SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, term) AS n FROM emb) WHERE n = 1) SELECT e.doc_id, round(sum(e.value * e.value), 6) AS dot, any_value(b.term) AS argmax FROM emb e JOIN best b USING (doc_id) GROUP BY e.doc_id",
    "integer_dot": f"WITH {VEC} SELECT doc_id, sum({code('value', 65535)} * {code('value', 65535)})::BIGINT AS dot FROM emb GROUP BY doc_id",
    "term_max_scores": f"WITH {VEC} SELECT term, greatest(max(value), 0.0) AS max_value, count(*) AS df FROM emb GROUP BY term",
    "postings_lambda": f"WITH {VEC}, {LISTS} SELECT term, doc_id, value FROM lists",
    "query_cut": f"{BASE}, {CUT} SELECT qid, term, weight, place::INT AS place FROM cut",
    "brute_topk": f"{BASE}, {SCORED}, every AS (SELECT x.qid, d.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT qid FROM q) x CROSS JOIN (SELECT DISTINCT doc_id FROM emb) d LEFT JOIN scored s USING (qid, doc_id)) {ranked('every')}",
    "brute_topk_padded": f"{BASE}, {SCORED}, {EVERY_LABELLED} {padded(ranked('every', 100), 'q', 100)}",
    "inverted_topk": INVERTED,
    "inverted_top100": f"{BASE}, {SCORED} {ranked('scored', 100, ' WHERE score > 0')}",
    "maxscore_topk": INVERTED,
    "dedupe_topk": f"{BASE}, {SCORED}, {BY_LABEL} {ranked('best', 5)}",
    "dedupe_topk_padded": f"{BASE}, {SCORED}, {BY_LABEL} {padded(ranked('best', 15), 'q', 15)}",
    "score_threshold": f"{BASE}, {SCORED} SELECT qid, score AS theta FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS n FROM scored) WHERE n = 10",
    "sq_encode_8bit": f"WITH {VEC} SELECT doc_id, term, {code('value', 255)} AS code FROM emb",
    "sq_encode_16bit": f"WITH {VEC} SELECT doc_id, term, {code('value', 65535)} AS code FROM emb",
    "sq_decode": f"WITH {VEC} SELECT doc_id, term, round({code('value', 255)}::DOUBLE * 0.6::DOUBLE / 255.0::DOUBLE, 9) AS value FROM emb",
    "sq_topk_8bit": quantized(255),
    "sq_topk_16bit": quantized(65535),
    "cluster_centroids": f"WITH {VEC}, {LISTS}, {HEADS} SELECT * FROM heads",
    "cluster_assign": f"WITH {VEC}, {LISTS}, {HEADS}, {MEMBERS} SELECT * FROM members",
    "cluster_sizes": f"WITH {VEC}, {LISTS}, {HEADS}, {MEMBERS} SELECT term, cluster_id, count(*) AS n FROM members GROUP BY 1, 2",
    "cluster_summary_max": f"WITH {VEC}, {LISTS}, {HEADS}, {MEMBERS}, {POOLED} SELECT * FROM pooled",
    "cluster_summary_alpha": f"WITH {VEC}, {LISTS}, {HEADS}, {MEMBERS}, {POOLED}, {SUMMARIES} SELECT * FROM summaries",
    "summary_scores": f"{BUILT} SELECT qid, term, cluster_id, round(s_score, 6) AS s_score FROM summed",
    "clustered_exhaustive_topk": f"{BUILT}, {EXHAUSTIVE} {ranked('full_')}",
    "clustered_setwise_topk": setwise(1.0),
    "clustered_setwise_filter_topk": setwise(1.2, "members WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label NOT IN (1, 3, 5))"),
    "clustered_sq_topk": SETWISE_SQ,
    "filter_include_topk": f"{BASE}, {SCORED} {ranked('scored', more=f' WHERE score > 0 AND doc_id IN {LABELLED}')}",
    "filter_exclude_topk": f"{BASE}, {SCORED} {ranked('scored', more=f' WHERE score > 0 AND doc_id NOT IN {LABELLED}')}",
    "exact_match_topk": EXACT,
    "idmap_topk": f"{BASE}, {SCORED}, best AS ({ranked('scored', more=' WHERE score > 0 AND (1000 + 3 * doc_id) % 2 = 0')}) SELECT qid, rank, (1000 + 3 * doc_id)::BIGINT AS doc_id, score FROM best",
    "recall_at_k": f"{BUILT}, {EXHAUSTIVE}, found_ AS ({ranked('full_')}), truth AS ({ranked('scored', more=' WHERE score > 0')}) SELECT t.qid, count(f.doc_id)::DOUBLE / count(*) AS recall FROM truth t LEFT JOIN found_ f ON f.qid = t.qid AND f.doc_id = t.doc_id GROUP BY t.qid",
    "store_roundtrip_topk": f"{BASE}, {SCORED} {padded(ranked('scored', more=' WHERE score > 0'), 'q')}",
    "index_include_topk": f"{BASE}, {SCORED}, every AS (SELECT x.qid, d.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT qid FROM q) x CROSS JOIN (SELECT DISTINCT doc_id FROM emb WHERE doc_id IN {LABELLED}) d LEFT JOIN scored s USING (qid, doc_id)) {padded(ranked('every'), 'q')}",
    "index_maxscore_topk": f"{BASE}, {SCORED} {padded(ranked('scored', more=' WHERE score > 0'), 'q')}",
    "index_exact_topk": EXACT,
    "factory_seismic_topk": with_pads(setwise(1.0)),
    "factory_seismic_sq_topk": with_pads(SETWISE_SQ),
    "idmap_seismic_store_topk": f"{BASE}, {SCORED} SELECT qid, rank, CASE WHEN doc_id < 0 THEN -1 ELSE 1000 + 3 * doc_id END::BIGINT AS doc_id, score FROM ({padded(ranked('scored', more=' WHERE score > 0'), 'q')})",
    "doc_lex_topk": f"WITH {LEX} {ranked('scored', more=' WHERE score > 0')}",
}
