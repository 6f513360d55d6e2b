"""Every named query against its SQL, and the shape of the plans that have to scale."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from recollect.catalog import all_queries
from tools.check import canonical

SQL = sorted(n for n, q in all_queries().items() if q.sql is not None)
SLOW = {"cache_step", "stream_cache", "compare_strategies"}  # run by tests of their own
ROWS_ONLY = sorted(n for n, q in all_queries().items() if q.sql is None and n not in SLOW)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf, con, name):
    q = all_queries()[name]
    df = q.build(spark, sf)
    res = con.execute(q.sql)
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(res.fetchall(), cols)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_gives_rows(spark, sf, name):
    assert all_queries()[name].build(spark, sf).count() > 0


def test_strategies_compare(spark, sf):
    rows = {r.strategy: r for r in all_queries()["compare_strategies"].build(spark, sf).collect()}
    assert len(rows) == 7 and len({r.total_queries for r in rows.values()}) == 1
    assert rows["exact"].tier2_hits == 0
    assert rows["static_low"].total_hits >= rows["static_high_priority"].tier2_hits
    for r in rows.values():
        assert r.total_hits == r.tier1_hits + r.tier2_hits and r.total_hits + r.total_misses == r.total_queries


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_join", "lsh_knn_join", "two_tier_lookup", "semantic_lookup", "causal_match", "exact_lookup"])
def test_similarity_joins_have_no_cross_product(spark, sf, name):
    text = plan(all_queries()[name].build(spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["running_hit_rate", "rolling_latency", "adaptive_global_threshold"])
def test_global_windows_sort_blocks_not_the_table(spark, sf, name):
    """Only block totals (one row per block) may meet in one partition."""
    text = plan(all_queries()[name].build(spark, sf))
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            assert "HashAggregate" in below, (line, below)


def test_filters_and_columns_reach_the_scan(spark, sf):
    from recollect.catalog import inputs as I
    from recollect.operators.replication import valid_records

    text = plan(I.table(spark, sf, "events").filter("event_id > 10").select("event_id"))
    assert "GreaterThan(event_id,10)" in text and "ReadSchema: struct<event_id:bigint>" in text
    log = I.table(spark, sf, "events").selectExpr("event_id AS lsn", "1 AS op", "encode(props, 'UTF-8') AS payload", "0L AS crc")
    assert "GreaterThan(event_id,7)" in plan(valid_records(log, 7))
