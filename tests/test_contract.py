"""Every registered query beside its SQL, and the plans of the queries that must scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import bag

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# The training-data queries have tests of their own.
QUERIES = {
    n: q for n, q in (contract.queries() if os.path.isdir(SF) else {}).items()
    if not n.startswith("op") and n != "pipeline"
}
FITTED = [n for n in QUERIES if n.startswith("cluster") and n != "cluster_checks"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in contract.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(cursor.fetchall(), names)


def test_entry_and_unmatched_queries(spark):
    assert contract.entry(spark).count() > 0
    assert set(QUERIES) - set(contract.oracle_sql()) == set(FITTED)


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_rows_and_no_cross_products(spark, name):
    text = plan(spark, name)
    for node in ("EvalPython", "MapInPandas", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert node not in text


@pytest.mark.parametrize("name", ["vendor_top15", "vendor_product_top30", "tag_top20",
                                  "tag_share_compare_top15", "case_candidates"])
def test_top_k_keeps_only_k_rows_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_search_conditions_reach_the_scan(spark):
    text = plan(spark, "search_core")
    scans = [line for line in text.splitlines() if "FileScan" in line and "o_orderstatus" in line]
    assert any("IsNotNull(o_orderstatus)" in s and "GreaterThanOrEqual(o_orderdate" in s for s in scans)


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "monthly_counts")
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in text
    text = plan(spark, "text_term_stats")
    assert "ReadSchema: struct<text:string>" in text
