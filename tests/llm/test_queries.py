"""The registered queries on the smallest tables, against SQL where there is some."""

import os

import duckdb
import pytest

from lumenta.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mix_sources": "doc_id size source_size target taken",
    "op2_pack_sequences": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_line_dedup": "doc_id n_lines n_removed text",
    "op4_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score word_score",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_repeated_strings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_near_duplicates": "doc_id n_shingles component_id kept",
    "op9_token_counts": "doc_id n_tokens file nth start",
    "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next edited_sections",
}


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == 200
    if name in SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        cur = con.execute(SQL[name])
        order = [[c[0] for c in cur.description].index(c) for c in df.columns]
        assert sorted(str([plain(x) for x in r]) for r in rows) == sorted(str([plain(r[i]) for i in order]) for r in cur.fetchall())


def test_merkle_stays_in_the_engine(spark):
    plan = QUERIES["op10_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
