"""Every registered query against its SQL; SKYGAUGE_FEW_QUERIES=1 runs one in six."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SMALL

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, norm  # noqa: E402
from skygauge.sources import adapters  # noqa: E402

SQL = entry.oracle_sql()
NAMES = sorted(SQL)[::6] if os.environ.get("SKYGAUGE_FEW_QUERIES") else sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(SQL[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == cols
    want = sorted((tuple(norm(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want and got


@pytest.mark.parametrize("name", ["a07_city_metrics", "a09_baseline_comparison", "a10_extreme_day_errors", "a11_weekly_mart", "a26_error_histogram", "t09_long_payload", "t10_extreme_days",
                                  "j04_daily_mart", "j05_semi_join_locations", "pf12_point_lookup", "m09_year_folds", "w12_partition_statistics", "c01_fill_missing_dates", "s07_apply_encoding"])
def test_order_lines_are_read_once(spark, monkeypatch, name):
    reads, real = [], adapters.table
    monkeypatch.setattr(adapters, "table", lambda s, d, t: reads.append(t) or real(s, d, t))
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    scans = sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines())
    assert reads.count("lineitem") == 1 and scans <= 1


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 70


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())
