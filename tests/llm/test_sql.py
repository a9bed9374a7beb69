"""Queries of the llm operators against their SQL, over whole tables."""

import duckdb
import pytest

from skygauge.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == cols
    want = sorted((tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want and want
