"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenta.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in SQL:
        assert got
        return
    cur = db.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert [cols[i] for i in order] == sorted(df.columns)
    assert got == sorted(str([plain(r[i]) for i in order]) for r in cur.fetchall())


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
