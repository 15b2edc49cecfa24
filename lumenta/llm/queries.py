"""The queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.llm import language_id, lines, lm_scoring, media, merkle, minhash, mixing, packing, suffixes, token_files
from lumenta.llm.common import documents, id_crc, stored


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "text")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(stored(media.images(documents(spark, sf_dir).select("doc_id", "text")), "media"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "text", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"))
    return language_id.predict(rows, language_id.fit(docs), ["doc_id", "held_out"])


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=85).drop("text_hash", "component")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(token_files.flatten(documents(spark, sf_dir).select("doc_id", "text")), "tokens")
    return token_files.counted(files)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.withColumn("edited_sections", F.array_join(F.col("edited_sections").cast("array<string>"), ","))


OP1_SQL = r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
nth AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM src),
weighted AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(nth % 3 + 1)::INT] AS weight FROM nth),
running AS (SELECT *,
  coalesce(sum(source_size) OVER (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
  sum(source_size) OVER () AS total FROM weighted),
tried AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * capped::DOUBLE) / open_weight AS level FROM running),
target AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM tried WHERE level * weight <= 2.0::DOUBLE * source_size) * weight, 'inf'::DOUBLE)) AS target FROM tried),
rated AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM rated
"""

OP3_SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(len(ls) - 2)) AS place, ls FROM cut WHERE len(ls) >= 3),
keyed AS (SELECT doc_id, place, row_number() OVER (PARTITION BY ls[place + 1] || chr(10) || ls[place + 2] || chr(10) || ls[place + 3] ORDER BY doc_id NULLS LAST, place) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, place + k AS line FROM keyed, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
gathered AS (SELECT doc_id, list(line) AS lines FROM gone GROUP BY doc_id)
SELECT c.doc_id, coalesce(len(c.ls), 0)::BIGINT AS n_lines, coalesce(len(g.lines), 0)::BIGINT AS n_removed,
  CASE WHEN g.lines IS NULL THEN c.text WHEN len(g.lines) = len(c.ls) THEN ''
    ELSE array_to_string(list_transform(list_filter(range(len(c.ls)), lambda i: NOT list_contains(g.lines, i)), lambda i: c.ls[i + 1]), chr(10)) END AS text
FROM cut c LEFT JOIN gathered g ON c.doc_id = g.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT i.a, i.b FROM both_ i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id, w.doc_id = least.component_id AS kept FROM w JOIN least ON least.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP10_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
chained AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS nxt FROM base),
edited AS (SELECT doc_id, text, nxt, substr(text, 1, length(text) - length(text) // 3) || substr(nxt, 1, length(text) // 3) AS edit FROM chained),
leafed AS (SELECT *, list_transform([text, edit, nxt], lambda t: list_transform(string_split(t, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,64}[.!?]*|[.!?]+'), lambda x: substr(md5(x), 1, 16)))) AS lv FROM edited),
par AS (SELECT *, list_transform(lv, lambda t: list_transform(t, lambda x: substr(md5(list_reduce(list_concat([''], x), lambda a, b: a || b)), 1, 16))) AS ps FROM leafed),
sec AS (SELECT *, list_transform(ps, lambda t: list_transform(range((len(t) + 7) // 8), lambda i: substr(md5(list_reduce(t[i * 8 + 1 : i * 8 + 8], lambda a, b: a || b)), 1, 16))) AS ss FROM par),
rt AS (SELECT *, list_transform(ss, lambda t: md5(list_reduce(t, lambda a, b: a || b))) AS rs, list_transform(lv, lambda t: flatten(t)) AS fl FROM sec),
out AS (SELECT *, list_transform(fl, lambda t: list_distinct(t)) AS ds,
  list_transform([1, 2], lambda i: rs[i] || '/' || array_to_string(ss[i], ',') || '/' || array_to_string(ps[i], ',') || '/' || array_to_string(fl[i], ',')) AS fps FROM rt)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edit) AS edited_sha256, fps[1] AS fingerprint, fps[2] AS edited_fingerprint,
  CASE WHEN rs[1] = rs[2] THEN 1.0 WHEN greatest(len(ds[1]), len(ds[2])) = 0 THEN 0.0 ELSE len(list_intersect(ds[1], ds[2]))::DOUBLE / greatest(len(ds[1]), len(ds[2])) END::DOUBLE AS near_edited,
  CASE WHEN rs[1] = rs[3] THEN 1.0 WHEN greatest(len(ds[1]), len(ds[3])) = 0 THEN 0.0 ELSE len(list_intersect(ds[1], ds[3]))::DOUBLE / greatest(len(ds[1]), len(ds[3])) END::DOUBLE AS near_next,
  coalesce(array_to_string(list_filter(range(greatest(len(ss[1]), len(ss[2]))), lambda i: ss[1][i + 1] IS DISTINCT FROM ss[2][i + 1]), ','), '') AS edited_sections
FROM out
"""

QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_pack_sequences": op2_pack_sequences, "op3_line_dedup": op3_line_dedup, "op4_media": op4_media, "op5_lm_scores": op5_lm_scores, "op6_language_id": op6_language_id, "op7_repeated_strings": op7_repeated_strings, "op8_near_duplicates": op8_near_duplicates, "op9_token_counts": op9_token_counts, "op10_fingerprints": op10_fingerprints}
SQL = {"op1_mix_sources": OP1_SQL, "op3_line_dedup": OP3_SQL, "op8_near_duplicates": OP8_SQL, "op10_fingerprints": OP10_SQL}
