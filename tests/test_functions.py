import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolecall.functions.dates import day
from rolecall.functions.digest import digest, joined, limb_sums
from rolecall.functions.hotkeys import keep_members, running_total
from rolecall.functions.text import (
    WHITESPACE,
    contains_ci,
    full_match,
    has_edge_whitespace,
    is_blank,
    strip,
)
from rolecall.session import cut_lineage


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=WHITESPACE + "aé中Z", max_size=12), min_size=1, max_size=30))
def test_strip_equals_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(strip(F.col("s"))).collect()]
    assert got == [t.strip() for t in texts]


def test_blank_and_edges(spark):
    rows = [(None,), ("",), (" \t ",), ("a",), (" a",)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(is_blank(df, "s"), has_edge_whitespace("s")).collect()
    assert [tuple(r) for r in got] == [
        (True, False), (True, False), (True, True), (False, False), (False, True),
    ]
    lists = spark.createDataFrame([([],), (None,)], "t array<string>")
    assert [r[0] for r in lists.select(is_blank(lists, "t")).collect()] == [False, True]


def test_full_match_refuses_a_trailing_newline(spark):
    df = spark.createDataFrame([("CWE-79",), ("CWE-79\n",), ("xCWE-79",), (None,)], "s string")
    got = [r[0] for r in df.select(full_match("s", r"CWE-[0-9]+")).collect()]
    assert got == [True, False, False, False]


def test_contains_is_literal_and_ignores_case(spark):
    df = spark.createDataFrame([("Micro.Soft",), ("MicroXsoft",), (None,)], "s string")
    assert [r[0] for r in df.select(contains_ci("s", "micro.")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(contains_ci("s", "100%_")).collect()] == [False] * 3


def test_strict_days(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-2-3", "2024-01-01 ", "2024-01-01\n", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] is not None for r in df.select(day(df, "s")).collect()]
    assert got == [True] + [False] * 6


@pytest.mark.parametrize("hot_share", [0, 3, 2])
def test_keep_members_with_a_hot_key(spark, hot_share):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = F.col("id") % 700
        if hot_share:
            key = F.when(F.col("id") % hot_share == 0, F.lit(-1)).otherwise(key)
        rows = spark.range(0, 3000, 1, 6).select(key.alias("k"), F.col("id").alias("pos"))
        rows = rows.unionByName(spark.range(5000, 5400).select(F.col("id").alias("k"), F.col("id").alias("pos")))
        groups = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
        got = sorted(r.pos for r in keep_members(rows, groups, "k").collect())
        want = sorted(r.pos for r in rows.join(groups, "k", "left_semi").collect())
        assert got == want and got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keep_members_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 8000, 1, 16).select(
            F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 2000).alias("k"), "id"
        )
        groups = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
        members = keep_members(rows, groups, "k").filter("k = -1")
        sizes = members.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_running_total_over_ranges(spark):
    df = cut_lineage(spark.range(0, 500).select(
        (F.col("id") * 7919 % 13).alias("n"), F.format_string("v%03d", "id").alias("name")
    ))
    order = [F.desc("n"), F.asc("name")]
    summed = running_total(df, "n", order, "total")
    want, total = {}, 0
    for r in sorted(df.collect(), key=lambda r: (-r.n, r.name)):
        total += r.n
        want[r.name] = total
    assert {r.name: r.total for r in summed.collect()} == want


def test_digest_makes_each_text_and_hash_once(spark):
    rows = [(1, 0.5, "a", [1, None], (None,)), (None, None, None, None, None), (2, float("nan"), "", [], (3.0,))]
    df = spark.createDataFrame(rows, "k int, x double, `s.t` string, l array<int>, r struct<y: double>")
    found = digest(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
    assert found.first().fingerprint == joined(df.agg(*limb_sums(df)).first())
    assert {r.k: r.row_count for r in digest(df, "k").collect()} == {1: 1, 2: 1, None: 1}
