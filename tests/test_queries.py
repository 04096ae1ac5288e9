"""Queries against their SQL on the smallest tables; skipped where the tables aren't there."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from linkgraph.plans import catalogue

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}")
    return value


def compare(spark, sql, query, text):
    df = query(spark, DATA)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    result = sql.execute(text)
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, sql, name):
    compare(spark, sql, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark):
    """The scan of a projection reads its columns only, with the filter pushed."""
    plan = catalogue.queries()["canonical_pages"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNull(deleted_at)" in plan
    plan = catalogue.queries()["difficulty_histogram"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<difficulty:string>" in plan
