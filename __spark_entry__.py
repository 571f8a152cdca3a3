"""

Every query reads whole tables. The SQL states the same result independently, over the views
benchmark labels conversations.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rolecall.operators import (  # noqa: E402
    cases,
    concentration,
    durations,
    guards,
    prepare,
    quality,
    search,
    status,
    subsets,
    tags,
    textcluster,
    timeline,
)
from rolecall.functions.digest import digest  # noqa: E402
from rolecall.plans.publish import exists, fingerprint  # noqa: E402
from rolecall.session import checkpoint_root  # noqa: E402
from rolecall.sources import envelope, star  # noqa: E402
from rolecall.spec import MISTYPED, PRODUCT, ROW_INDEX, SOURCE, VENDOR  # noqa: E402

ORDERS, LINES, DOCS = star.ORDERS, star.LINES, star.DOCUMENTS
STOP = ("the", "and", "of", "in", "is", "on")


def entry(spark: SparkSession) -> DataFrame:
    """Vendor leaderboard with shares and cumulative shares."""
    return queries()["vendor_summary"](spark, "/root/testdata/sf0.001")


# --- building blocks ---------------------------------------------------------------------


def _months(spark, sf):
    orders = star.orders_catalog(spark, sf, labels=False, tags=False)
    return timeline.monthly_counts(timeline.observed_months(orders, ORDERS.opened))


def _windows(spark, sf):
    return durations.window_counts(star.line_windows(spark, sf))


def _states(spark, sf):
    return status.status_counts(star.orders_catalog(spark, sf, labels=False, tags=False), ORDERS)


def _order_pairs(spark, sf):
    return concentration.pair_counts(star.order_labels_weighted(spark, sf), "record_count")


def _line_pairs(spark, sf):
    return concentration.pair_counts(star.line_labels_weighted(spark, sf), "record_count")


def _tagged(spark, sf):
    """Orders and their long tag table; order keys are unique."""
    orders = star.orders_catalog(spark, sf)
    return orders, tags.long_table(orders, ORDERS, unique_ids=True)


def _shown(df: DataFrame) -> DataFrame:
    """Tag lists as compact JSON, the form text outputs use."""
    return df.withColumn("brands", F.to_json("brands")).drop("n_name", "c_mktsegment")


SEARCH = search.Criteria(
    start_date="1996-03-01", end_date="1999-12-31", vendor=" nation_1 ", status="F", tag="Brand#2"
)
EXTENDED = search.Criteria(start_date="1997-01-01", vendor="Nation_2", product="build")
LITERAL = search.Criteria(vendor="NATION.*")


def _search(criteria, part):
    def query(spark, sf):
        result = search.search(star.orders_catalog(spark, sf), ORDERS, criteria, checked=True)
        return _shown(result[0]) if part == 0 else result[1]

    return query


def _found(spark, sf):
    return search.matching(star.orders_catalog(spark, sf), ORDERS, SEARCH, checked=True)


def _cases(spark, sf):
    orders = star.orders_catalog(spark, sf)
    return cases.run_cases(orders, ORDERS, unique_ids=True, checked=True)


def _compare(spark, sf):
    orders, long = _tagged(spark, sf)
    return tags.compare_shares(
        tags.positive(orders, long, ORDERS), tags.other(orders, long, ORDERS), ORDERS
    )


def _envelope_records(spark, sf):
    flat = envelope.flatten_records(star.order_envelopes(spark, sf))
    return envelope.typed_records(flat, star.ENVELOPED).drop(MISTYPED, SOURCE)


def _envelope_metadata(spark, sf):
    docs = star.order_envelopes(spark, sf)
    stated = envelope.metadata(docs, star.ENVELOPED)
    return stated.groupBy("title", "dateReleased").agg(
        F.sum("count").alias("declared"), F.sum("actualRecordCount").alias("actual")
    )


def _envelope_problems(spark, sf):
    """Envelope and record checks over documents and records, counted per finding."""
    docs = star.order_envelopes(spark, sf)
    broken = envelope.envelope_problems(docs).filter("problems IS NOT NULL")
    # A contract with one field too few: every record has an extra and no missing field.
    narrow = star.ENVELOPED.with_options(
        fields=tuple(f for f in star.ENVELOPED.raw_fields if f != "o_custkey")
    )
    flat = envelope.flatten_records(docs)
    extra = envelope.record_problems(flat, narrow).filter("extra = array('o_custkey')")
    return broken.agg(F.count("*").alias("n")).select(F.lit("envelope").alias("kind"), "n").union(
        extra.agg(F.count("*").alias("n")).select(F.lit("extra field").alias("kind"), "n")
    )


def _line_records(spark, sf):
    """Lines of the order envelopes as typed records, with what breaks the contract."""
    flat = envelope.flatten_records(star.line_envelopes(spark, sf))
    return envelope.typed_records(flat, star.LINE_RECORDS, findings=True)


def _envelope_line_documents(spark, sf):
    """Broken envelope rules with the number of documents that break them."""
    found = envelope.envelope_problems(star.line_envelopes(spark, sf))
    rule = F.explode("problems").alias("problem")
    return found.select(rule).groupBy("problem").agg(F.count("*").alias("document_count"))


def _envelope_line_findings(spark, sf):
    """Findings over all records in one pass: (kind, field, record_count)."""
    found = {
        "not an object": F.when(F.col("not_an_object"), F.array(F.lit(""))),
        "missing": F.col("missing"),
        "extra": F.col("extra"),
        "mistyped": F.map_keys(MISTYPED),
    }

    def pairs(kind, names):
        return F.transform(
            F.coalesce(names, F.array().cast("array<string>")),
            lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("field")),
        )

    all_pairs = F.concat(*[pairs(kind, names) for kind, names in found.items()])
    rows = _line_records(spark, sf).select(F.inline(all_pairs))
    return rows.groupBy("kind", "field").agg(F.count("*").alias("record_count"))


def _envelope_line_records(spark, sf):
    rows = _line_records(spark, sf).drop(SOURCE, *envelope.FINDINGS)
    return rows.withColumn("flags", F.to_json("flags")).withColumn(
        MISTYPED, F.array_join(F.array_sort(F.map_keys(MISTYPED)), ",")
    )


def _tag_long_repeated_ids(spark, sf):
    """The long tag table of lines whose order ids repeat: the first line of each (order, flag)."""
    rows = _line_records(spark, sf).drop(SOURCE, *envelope.FINDINGS)
    return tags.long_table(prepare.prepare(rows, star.LINE_RECORDS)[0], star.LINE_RECORDS)


def _guard_findings(spark, sf):
    """All guards over all orders, under a stated period, a narrow domain and a strict tag pattern."""
    strict = ORDERS.with_options(
        period_start="1995-06", period_end="2000-12", status_domain=("F", "O"),
        tag_pattern="Brand#[0-9]",
    )
    return guards.findings(star.orders_catalog(spark, sf), strict)


def _raw_orders(spark, sf):
    return star.orders_catalog(spark, sf).select(*ORDERS.raw_fields)


def _tag_issues(spark, sf):
    """Tag rules over all orders, with a pattern that refuses two-digit brands."""
    strict = ORDERS.with_options(tag_pattern="Brand#[0-9]")
    return quality.issues(_raw_orders(spark, sf), strict)


def _counters(spark, sf):
    found = quality.counters(_raw_orders(spark, sf), ORDERS)
    return _raw_orders(spark, sf).agg(*[c.alias(n) for n, c in found.items()])


def _analysis_text(spark, sf):
    docs = star.documents_catalog(spark, sf)
    text = textcluster.analysis_text(DOCS)
    return docs.select(
        "doc_id", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("digest")
    )


def _term_stats(spark, sf):
    docs = star.documents_catalog(spark, sf)
    return textcluster.term_stats(
        textcluster.with_terms(docs, textcluster.analysis_text(DOCS), list(STOP))
    )


def _vocabulary(spark, sf):
    n_docs = star.table(spark, sf, "documents").count()
    return textcluster.top_terms(_term_stats(spark, sf), n_docs)


def _text_weights(spark, sf):
    docs = star.documents_catalog(spark, sf)
    n_docs = star.table(spark, sf, "documents").count()
    vectors, vocab = textcluster.features(docs, DOCS, n_docs, list(STOP))
    found = textcluster.weights(vectors, vocab, DOCS)
    return found.withColumn("weight", F.round("weight", 6))


CLUSTER_TABLES = ("selection", "records", "summary", "keywords", "projection")


def _clusters(part):
    """One table of the analysis with the operator's defaults. The tables are stored in the shared
    folder under the digest of the records they come from: the first query over new or changed records
    fits, the others read what it has stored."""

    def query(spark, sf):
        docs = star.documents_catalog(spark, sf)
        row = digest(docs).first()
        kept = f"{checkpoint_root(spark)}/clusters-{row.row_count}-{row.fingerprint}"
        if not exists(spark, f"{kept}/_done/_SUCCESS"):
            found = textcluster.analyze(docs, DOCS)
            for name in CLUSTER_TABLES:
                df = found.projection() if name == "projection" else getattr(found, name)
                df.write.mode("overwrite").parquet(f"{kept}/{name}")
            found.release()
            spark.range(1).write.mode("overwrite").parquet(f"{kept}/_done")
        return spark.read.parquet(f"{kept}/{part}")

    return query


def _cluster_checks(spark, sf):
    """What must hold of the clustering whatever the fits find, as (check_name, value)."""
    selection, records, summary, keywords = (
        _clusters(p)(spark, sf) for p in ("selection", "records", "summary", "keywords")
    )
    per_cluster = keywords.groupBy("cluster_id").agg(F.count_distinct("keyword_rank").alias("n"))
    checks = (
        ("candidates", selection, F.count("*")),
        ("selected", selection, F.count_if("selected")),
        ("documents", records, F.count("*")),
        ("ids", records, F.count_distinct("doc_id")),
        ("members", summary, F.sum("record_count")),
        ("known", summary, F.sum("known_count")),
        ("share in millionths", summary, F.round(F.sum("share") * 1_000_000).cast("bigint")),
        ("fewest keywords", per_cluster, F.min("n")),
        ("most keywords", per_cluster, F.max("n")),
    )
    rows = [df.agg(v.alias("value")).select(F.lit(n).alias("check_name"), "value") for n, df, v in checks]
    found = rows[0]
    for row in rows[1:]:
        found = found.union(row)
    return found


def _event_pairs(spark, sf):
    return concentration.pair_counts(star.events_catalog(spark, sf))


def _lines(spark, sf):
    return star.lines_catalog(spark, sf)


def _llm(name: str) -> dict:
    """Entries of the training-data subpackage and its pipeline; empty without them."""
    found = {}
    for module in ("rolecall.llm.queries", "corpus_pipeline"):
        if importlib.util.find_spec(module.split(".")[0]) is None:
            continue
        try:
            found |= getattr(importlib.import_module(module), name)
        except ModuleNotFoundError as err:
            if not (err.name or "").startswith(("rolecall.llm", "corpus_pipeline")):
                raise
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **_llm("QUERIES"),
        # time
        "monthly_counts": _months,
        "annual_summary": lambda s, d: timeline.annual_summary(_months(s, d)),
        "same_period": lambda s, d: timeline.same_period(_months(s, d), ORDERS.comparison_months),
        # window length
        "window_descriptive": lambda s, d: durations.descriptive(_windows(s, d)),
        "window_frequency": lambda s, d: durations.frequency(_windows(s, d)),
        "window_by_year": lambda s, d: durations.by_year(_windows(s, d)),
        "window_band_by_year": lambda s, d: durations.bands_by_year(_windows(s, d)),
        "window_box": lambda s, d: durations.box_summary(_windows(s, d)),
        # status
        "status_totals": lambda s, d: status.totals(_states(s, d), ORDERS),
        "status_by_year": lambda s, d: status.by_year(_states(s, d), ORDERS),
        "status_unsupported": lambda s, d: status.unsupported_statuses(
            star.table(s, d, "lineitem"), LINES
        ),
        # vendors and products
        "vendor_summary": lambda s, d: concentration.vendor_summary(_order_pairs(s, d)),
        "vendor_summary_events": lambda s, d: concentration.vendor_summary(_event_pairs(s, d)),
        "vendor_curve": lambda s, d: concentration.vendor_curve(_order_pairs(s, d)),
        "vendor_top15": lambda s, d: concentration.top_vendors(_line_pairs(s, d)),
        "vendor_product_summary": lambda s, d: concentration.product_summary(_order_pairs(s, d)),
        "vendor_product_top30": lambda s, d: concentration.top_products(_line_pairs(s, d)),
        "concentration": lambda s, d: concentration.metrics(_line_pairs(s, d)),
        "vendor_product_rollup": lambda s, d: concentration.hierarchy(_order_pairs(s, d)),
        "product_count_distribution": lambda s, d: concentration.product_count_distribution(
            _line_pairs(s, d)
        ),
        # tags
        "tag_long": lambda s, d: _tagged(s, d)[1],
        "tag_long_keep_first": lambda s, d: tags.long_table(star.orders_catalog(s, d), ORDERS),
        "tag_overall": lambda s, d: tags.overall(*_tagged(s, d), ORDERS),
        "tag_positive": lambda s, d: tags.positive(*_tagged(s, d), ORDERS),
        "tag_other": lambda s, d: tags.other(*_tagged(s, d), ORDERS),
        "tag_top20": lambda s, d: tags.top_tags(tags.overall(*_tagged(s, d), ORDERS), ORDERS),
        "tag_share_compare_top15": _compare,
        # search
        "search_core": _search(SEARCH, 0),
        "search_summary": _search(SEARCH, 1),
        "search_extended": _search(EXTENDED, 0),
        "search_empty": _search(LITERAL, 1),
        "point_lookup": lambda s, d: _shown(
            search.by_id(star.orders_catalog(s, d), ORDERS, 17)
        ),
        "subset_monthly": lambda s, d: subsets.monthly(_found(s, d)),
        "subset_vendors": lambda s, d: subsets.vendors(_found(s, d), ORDERS),
        "subset_tags": lambda s, d: subsets.tags(_found(s, d), ORDERS, unique_ids=True),
        # cases
        "case_candidates": lambda s, d: cases.top_candidates(
            star.orders_catalog(s, d), ORDERS, unique_ids=True
        ),
        "case_leaders": lambda s, d: cases.leaders(star.orders_catalog(s, d), ORDERS),
        "query_cases_summary": lambda s, d: _cases(s, d).summary,
        "query_cases_rows": lambda s, d: _shown(_cases(s, d).rows),
        # quality and preparation
        "quality_summary": lambda s, d: quality.check_summary(_lines(s, d), LINES),
        "quality_issues": lambda s, d: quality.issues(_lines(s, d), LINES),
        "quality_issues_tags": _tag_issues,
        "quality_counters": _counters,
        "field_profile": lambda s, d: quality.field_profile(_lines(s, d)),
        "prepared": lambda s, d: prepare.prepare(_lines(s, d), LINES)[0],
        "rejected": lambda s, d: prepare.prepare(_lines(s, d), LINES)[1].withColumn(
            "reject_reasons", F.to_json("reject_reasons")
        ),
        # envelopes
        "envelope_records": _envelope_records,
        "envelope_metadata": _envelope_metadata,
        "envelope_problems": _envelope_problems,
        "envelope_line_documents": _envelope_line_documents,
        "envelope_line_findings": _envelope_line_findings,
        "envelope_line_records": _envelope_line_records,
        "tag_long_repeated_ids": _tag_long_repeated_ids,
        "guard_findings": _guard_findings,
        # outputs
        "table_fingerprint": lambda s, d: fingerprint(star.table(s, d, "lineitem")).drop("columns"),
        # text
        "analysis_text": _analysis_text,
        "text_term_stats": _term_stats,
        "text_vocabulary": _vocabulary,
        "text_weights": _text_weights,
        "cluster_checks": _cluster_checks,
        "cluster_selection": _clusters("selection"),
        "cluster_records": _clusters("records"),
        "cluster_summary": _clusters("summary"),
        "cluster_keywords": _clusters("keywords"),
        "cluster_projection": _clusters("projection"),
    }


# --- the same results in SQL -------------------------------------------------------------

_MONTHS = """
seen AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1),
spine AS (
  SELECT strftime(d, '%Y-%m') AS added_month FROM (
    SELECT unnest(generate_series(
      (SELECT date_trunc('month', min(o_orderdate)) FROM orders)::TIMESTAMP,
      (SELECT max(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 1 MONTH)) AS d)),
monthly AS (
  SELECT added_month, CAST(coalesce(n, 0) AS BIGINT) AS record_count,
         CAST(added_month[1:4] AS BIGINT) AS added_year, CAST(added_month[6:7] AS BIGINT) AS mo
  FROM spine LEFT JOIN seen ON added_month = m)
"""
_DAYS = """
w AS (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS added_year,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS dd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dw AS (SELECT * FROM w WHERE dd >= 0)
"""
_ORDER_PAIRS = """
rec AS (
  SELECT n_name AS vendor_clean, c_mktsegment AS product_clean
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
_LINE_PAIRS = """
rec AS (
  SELECT s_name AS vendor_clean, p_name AS product_clean
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
"""
_EVENT_PAIRS = """
rec AS (SELECT event_type AS vendor_clean, CAST(user_id AS VARCHAR) AS product_clean FROM events)
"""
_VENDORS = """
ven AS (
  SELECT vendor_clean, count(*) AS n, count(DISTINCT product_clean) AS products
  FROM rec GROUP BY 1)
"""
_TAGGED = """
t AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
oc AS (
  SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus,
         n_name AS vendor_clean, c_mktsegment AS product_clean,
         CAST(year(o_orderdate) AS BIGINT) AS added_year,
         strftime(o_orderdate, '%Y-%m') AS added_month
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
tl AS (
  SELECT o_orderkey, p_brand AS brand, o_orderstatus, o_orderdate, vendor_clean, product_clean,
         added_year
  FROM oc JOIN t ON o_orderkey = l_orderkey),
sets AS (
  SELECT l_orderkey, '[' || string_agg('"' || p_brand || '"', ',' ORDER BY p_brand) || ']' AS j,
         count(*) AS k
  FROM t GROUP BY 1),
shown AS (
  SELECT o_orderkey, o_orderpriority, o_orderdate, o_orderstatus, coalesce(j, '[]') AS brands,
         coalesce(k, 0) > 0 AS has_brand, CAST(coalesce(k, 0) AS BIGINT) AS brand_count,
         vendor_clean, product_clean, added_year, added_month
  FROM oc LEFT JOIN sets ON o_orderkey = l_orderkey)
"""
_SUMMARY = """
count(*) AS record_count, count(DISTINCT vendor_clean) AS vendor_count,
max(o_orderdate) AS max_date, count(*) FILTER (WHERE o_orderstatus = 'F') AS f_count
"""
_CORE = """
o_orderdate BETWEEN DATE '1996-03-01' AND DATE '1999-12-31'
AND contains(upper(vendor_clean), 'NATION_1') AND o_orderstatus = 'F'
AND contains(brands, '"Brand#2"')
"""
_CASES = """
c1 AS (
  SELECT 1 AS case_id, added_year AS year, vendor_clean AS vendor, CAST(NULL AS VARCHAR) AS tag,
         count(DISTINCT o_orderkey) AS record_count
  FROM oc WHERE o_orderstatus = 'F' GROUP BY added_year, vendor_clean
  ORDER BY record_count DESC, added_year, vendor_clean LIMIT 1),
c2 AS (
  SELECT 2 AS case_id, CAST(NULL AS BIGINT) AS year, vendor_clean AS vendor, brand AS tag,
         count(DISTINCT o_orderkey) AS record_count
  FROM tl GROUP BY vendor_clean, brand ORDER BY record_count DESC, vendor_clean, brand LIMIT 1),
c3 AS (
  SELECT 3 AS case_id, added_year AS year, CAST(NULL AS VARCHAR) AS vendor, brand AS tag,
         count(DISTINCT o_orderkey) AS record_count
  FROM tl WHERE o_orderstatus = 'O' GROUP BY added_year, brand
  ORDER BY record_count DESC, added_year, brand LIMIT 1),
top AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
cases AS (
  SELECT case_id, year || '-01-01' AS start_date, year || '-12-31' AS end_date, vendor,
         CASE case_id WHEN 1 THEN 'F' WHEN 3 THEN 'O' END AS status, tag
  FROM top),
hits AS (
  SELECT case_id, shown.* FROM cases JOIN shown ON
    (start_date IS NULL OR o_orderdate >= CAST(start_date AS DATE))
    AND (end_date IS NULL OR o_orderdate <= CAST(end_date AS DATE))
    AND (vendor IS NULL OR contains(upper(vendor_clean), upper(vendor)))
    AND (status IS NULL OR o_orderstatus = status)
    AND (tag IS NULL OR contains(brands, '"' || tag || '"')))
"""
_LINE_RECORDS = """
placed AS (
  SELECT *, l_quantity = 50 AS bare,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice) - 1 AS row_index
  FROM lineitem),
lr AS (
  SELECT row_index, bare,
         CASE WHEN NOT bare THEN CAST(l_orderkey AS VARCHAR) END AS l_orderkey,
         CASE WHEN NOT bare AND l_quantity >= 5 THEN CAST(l_suppkey AS VARCHAR) END AS l_suppkey,
         CASE WHEN NOT bare AND l_linenumber <> 7 THEN CAST(l_partkey AS VARCHAR) END AS l_partkey,
         CASE WHEN NOT bare THEN strftime(l_shipdate, '%Y-%m-%d') END AS l_shipdate,
         CASE WHEN NOT bare THEN l_returnflag END AS l_returnflag,
         CASE WHEN NOT bare AND l_tax <> 0 THEN l_returnflag END AS flag_1,
         CASE WHEN NOT bare AND l_tax <> 0 THEN l_linestatus END AS flag_2,
         NOT bare AND l_tax = 0 AS bad_flags, NOT bare AND l_quantity < 5 AS bad_supplier,
         NOT bare AND l_linenumber = 7 AS no_part, NOT bare AND l_discount = 0 AS has_comment
  FROM placed)
"""
_RAW_LINES = """
raw AS (
  SELECT l_orderkey || '-' || l_linenumber AS line_id, s_name, p_name,
         CAST(o_orderdate AS DATE) AS o_orderdate, CAST(l_shipdate AS DATE) AS l_shipdate,
         l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey),
rep AS (SELECT line_id FROM raw GROUP BY 1 HAVING count(*) > 1)
"""


def _tag_summary(where: str, share: str) -> str:
    return f"""WITH {_TAGGED},
    part_of AS (SELECT * FROM tl WHERE {where}),
    d AS (SELECT count(DISTINCT o_orderkey) AS n FROM part_of)
    SELECT brand, count(DISTINCT o_orderkey) AS distinct_order_count,
           CAST(any_value(d.n) AS BIGINT) AS denominator,
           count(DISTINCT o_orderkey) / CAST(any_value(d.n) AS DOUBLE) AS {share}
    FROM part_of, d GROUP BY brand"""


def _check(code: str, passed: str, actual: str, expected: str) -> str:
    severity, name, message = quality.CHECKS[code]
    return (
        f"SELECT '{code}' AS check_id, '{name}' AS check_name, '{severity}' AS severity, "
        f"{passed} AS passed, CAST({actual} AS VARCHAR) AS actual, '{expected}' AS expected, "
        f"'{message}' AS message"
    )


def _zero_check(code: str, count: str, expected: str = "0") -> str:
    return _check(code, f"({count}) = 0", f"({count})", expected)


def _issue(code: str, column: str, where: str) -> str:
    severity, _, message = quality.CHECKS[code]
    return (
        f"SELECT '{code}' AS issue_code, '{severity}' AS severity, CAST(NULL AS BIGINT) AS "
        f"row_index, line_id, '{column}' AS field, CAST({column} AS VARCHAR) AS observed_value, "
        f"'{message}' AS message FROM raw WHERE {where}"
    )


def _profile(column: str, dtype: str) -> str:
    return (
        f"SELECT '{column}' AS field, '{dtype}' AS dtype, count(*) AS row_count, "
        f"count({column}) AS non_null_count, count(*) - count({column}) AS null_count, "
        f"count(*) FILTER (WHERE {column} IS NOT NULL AND trim(CAST({column} AS VARCHAR)) = '') "
        f"AS empty_string_count, count(DISTINCT {column}) AS unique_count FROM raw"
    )


_BAD_STATUS = "l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'R')"
_LEADERBOARD = """
SELECT vendor_clean, n AS record_count, n / CAST(sum(n) OVER () AS DOUBLE) AS share,
       CAST(sum(n) OVER (ORDER BY n DESC, vendor_clean) AS DOUBLE)
         / CAST(sum(n) OVER () AS DOUBLE) AS cumulative_share,
       products AS product_count
FROM ven
"""


def _digest_sql(table: str, columns: dict[str, str]) -> str:
    """The digest of ``rolecall.functions.digest`` over columns of kinds text, float and time."""
    grid = f"{2**40}.0"

    def text(name: str, kind: str) -> str:
        if kind == "time":
            return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"
        if kind == "text":
            return f"CAST({name} AS VARCHAR)"
        rest = f"(abs({name}) - floor(abs({name}) / {grid}) * {grid})"
        first = f"(({rest} - floor({rest})) * {grid})"
        second = f"(({first} - floor({first})) * {grid})"
        parts = [f"CAST(floor({p}) AS BIGINT)" for p in (f"abs({name}) / {grid}", rest, first, second)]
        joined = " || '_' || ".join(parts)
        return (f"CASE WHEN isnan({name}) THEN 'nan' WHEN isinf({name}) THEN CASE WHEN {name} > 0 THEN 'inf' "
                f"ELSE '-inf' END ELSE CASE WHEN {name} < 0 THEN 'f-' ELSE 'f' END || {joined} END")

    row = " || ".join(
        f"coalesce(strlen({text(c, k)}) || ':' || {text(c, k)}, '-')" for c, k in columns.items()
    )
    limbs = " || ".join(
        f"lpad(lower(to_hex(CAST(coalesce(sum(CAST(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT) "
        f"AS HUGEINT)), 0) % {2**64} AS UBIGINT))), 16, '0')" for i in range(4)
    )
    return f"""SELECT count(*) AS row_count, {limbs} AS fingerprint
        FROM (SELECT sha256({row}) AS h FROM {table})"""


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(f"'{w}'" for w in STOP)
    bands = ", ".join(
        f"count(*) FILTER (WHERE {cond}) AS \"{label}\""
        for (label, _, _), cond in zip(
            durations.BANDS,
            ("dd <= 7", "dd > 7 AND dd <= 14", "dd > 14 AND dd <= 30", "dd > 30 AND dd <= 60",
             "dd > 60"),
            strict=True,
        )
    )
    terms = rf"""
        w AS (
          SELECT doc_id, [x FOR x IN
            regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]{{2,}}')
            IF x NOT IN ({stop})] AS ws FROM documents),
        t AS (
          SELECT doc_id, unnest(ws) AS term FROM w
          UNION ALL
          SELECT doc_id, unnest([ws[i] || ' ' || ws[i + 1]
                                 FOR i IN generate_series(1, len(ws) - 1)]) FROM w),
        stats AS (
          SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_count
          FROM t GROUP BY 1)"""
    six = ("min(dd)", "quantile_cont(dd, 0.25)", "quantile_cont(dd, 0.5)",
           "CAST(sum(dd) AS DOUBLE) / count(*)", "quantile_cont(dd, 0.75)", "max(dd)")
    return {
        **_llm("SQL"),
        "monthly_counts": f"WITH {_MONTHS} SELECT added_month, record_count FROM monthly",
        "annual_summary": f"""WITH {_MONTHS}
            SELECT added_year, CAST(sum(record_count) AS BIGINT) AS record_count,
                   min(mo) AS first_month, max(mo) AS last_month, count(*) AS covered_months,
                   count(*) = 12 AS is_complete_year
            FROM monthly GROUP BY 1""",
        "same_period": f"""WITH {_MONTHS}
            SELECT added_year, CAST(1 AS BIGINT) AS period_start_month,
                   CAST(7 AS BIGINT) AS period_end_month,
                   CAST(sum(record_count) AS BIGINT) AS record_count
            FROM monthly
            WHERE mo BETWEEN 1 AND 7 AND added_year >= (SELECT min(added_year) + 1 FROM monthly)
            GROUP BY 1""",
        "window_descriptive": f"WITH {_DAYS} " + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS value, "
            f"CAST({i} AS BIGINT) AS metric_order FROM dw"
            for i, (m, e) in enumerate(zip(durations.METRICS, six, strict=True), 1)
        ),
        "window_frequency": f"""WITH {_DAYS}
            SELECT dd AS deadline_days, count(*) AS record_count,
                   count(*) / CAST((SELECT count(*) FROM dw) AS DOUBLE) AS share
            FROM dw GROUP BY 1""",
        "window_by_year": f"""WITH {_DAYS}
            SELECT added_year, count(*) AS record_count, CAST({six[0]} AS DOUBLE) AS min_days,
                   {six[1]} AS q1_days, {six[2]} AS median_days, {six[3]} AS mean_days,
                   {six[4]} AS q3_days, CAST({six[5]} AS DOUBLE) AS max_days
            FROM dw GROUP BY 1""",
        "window_band_by_year": f"WITH {_DAYS} SELECT added_year, {bands} FROM dw GROUP BY 1",
        "window_box": f"""WITH {_DAYS},
            b AS (SELECT quantile_cont(dd, 0.25) AS q1, quantile_cont(dd, 0.5) AS median,
                         quantile_cont(dd, 0.75) AS q3 FROM dw),
            lim AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
            SELECT CAST(min(dd) FILTER (WHERE dd BETWEEN lo AND hi) AS DOUBLE) AS lower_whisker,
                   q1, median, q3,
                   CAST(max(dd) FILTER (WHERE dd BETWEEN lo AND hi) AS DOUBLE) AS upper_whisker,
                   count(*) FILTER (WHERE dd < lo OR dd > hi) AS outlier_count
            FROM dw, lim GROUP BY q1, median, q3""",
        "status_totals": """
            SELECT s AS status, count(o_orderkey) AS record_count,
                   count(o_orderkey) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS share,
                   CAST(i AS BIGINT) AS status_order
            FROM (VALUES ('F', 1), ('O', 2), ('P', 3)) AS v(s, i)
            LEFT JOIN orders ON o_orderstatus = s GROUP BY s, i""",
        "status_by_year": """
            WITH c AS (
              SELECT CAST(year(o_orderdate) AS BIGINT) AS added_year,
                     count(*) FILTER (WHERE o_orderstatus = 'F') AS f_count,
                     count(*) FILTER (WHERE o_orderstatus = 'O') AS o_count,
                     count(*) FILTER (WHERE o_orderstatus = 'P') AS p_count,
                     count(*) AS total_count
              FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1)
            SELECT *, f_count / CAST(total_count AS DOUBLE) AS f_share,
                   o_count / CAST(total_count AS DOUBLE) AS o_share,
                   p_count / CAST(total_count AS DOUBLE) AS p_share FROM c""",
        "status_unsupported": """
            SELECT DISTINCT l_returnflag AS status FROM lineitem
            WHERE l_returnflag NOT IN ('A', 'R')""",
        "vendor_summary": f"WITH {_ORDER_PAIRS}, {_VENDORS} {_LEADERBOARD}",
        "vendor_summary_events": f"WITH {_EVENT_PAIRS}, {_VENDORS} {_LEADERBOARD}",
        "vendor_curve": f"""WITH {_ORDER_PAIRS}, {_VENDORS}
            SELECT row_number() OVER (ORDER BY n DESC, vendor_clean) AS rank, vendor_clean,
                   n AS record_count,
                   CAST(sum(n) OVER (ORDER BY n DESC, vendor_clean) AS DOUBLE)
                     / CAST(sum(n) OVER () AS DOUBLE) AS cumulative_share
            FROM ven""",
        "vendor_top15": f"""WITH {_LINE_PAIRS}, {_VENDORS}
            SELECT row_number() OVER (ORDER BY n DESC, vendor_clean) AS rank, vendor_clean,
                   n AS record_count, products AS product_count
            FROM ven ORDER BY rank LIMIT 15""",
        "vendor_product_summary": f"""WITH {_ORDER_PAIRS}
            SELECT vendor_clean, product_clean, count(*) AS record_count,
                   count(*) / CAST((SELECT count(*) FROM rec) AS DOUBLE) AS share
            FROM rec GROUP BY 1, 2""",
        "vendor_product_top30": f"""WITH {_LINE_PAIRS},
            p AS (SELECT vendor_clean, product_clean, count(*) AS record_count,
                         count(*) / CAST((SELECT count(*) FROM rec) AS DOUBLE) AS share
                  FROM rec GROUP BY 1, 2)
            SELECT row_number() OVER (ORDER BY record_count DESC, vendor_clean, product_clean)
                     AS rank, *, vendor_clean || ' - ' || product_clean AS label
            FROM p ORDER BY rank LIMIT 30""",
        "concentration": f"""WITH {_LINE_PAIRS}, {_VENDORS},
            r AS (SELECT n, row_number() OVER (ORDER BY n DESC, vendor_clean) AS rk FROM ven),
            s AS (SELECT CAST(sum(n) FILTER (WHERE rk <= 5) AS DOUBLE) AS t5,
                         CAST(sum(n) FILTER (WHERE rk <= 10) AS DOUBLE) AS t10,
                         CAST(sum(n * n) AS DOUBLE) AS sq, CAST(sum(n) AS DOUBLE) AS total FROM r)
            SELECT m AS metric, v AS value, '{concentration.SCOPE}' AS interpretation_scope,
                   CAST(i AS BIGINT) AS metric_order
            FROM (SELECT 'CR5' AS m, t5 / total AS v, 1 AS i FROM s
                  UNION ALL SELECT 'CR10', t10 / total, 2 FROM s
                  UNION ALL SELECT 'HHI', sq / (total * total), 3 FROM s)""",
        "vendor_product_rollup": f"""WITH {_ORDER_PAIRS}
            SELECT vendor_clean, product_clean, count(*) AS record_count,
                   CAST(CASE grouping_id(vendor_clean, product_clean)
                        WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS level
            FROM rec GROUP BY ROLLUP (vendor_clean, product_clean)""",
        "product_count_distribution": f"""WITH {_LINE_PAIRS}, {_VENDORS}
            SELECT products AS product_count, count(*) AS vendor_count FROM ven GROUP BY 1""",
        "tag_long": f"""WITH {_TAGGED} SELECT * EXCLUDE (added_year) FROM tl""",
        "tag_long_keep_first": f"""WITH {_TAGGED} SELECT * EXCLUDE (added_year) FROM tl""",
        "tag_overall": _tag_summary("true", "share"),
        "tag_positive": _tag_summary("o_orderstatus = 'F'", "f_share"),
        "tag_other": _tag_summary("o_orderstatus IN ('O', 'P')", "other_share"),
        "tag_top20": _tag_summary("true", "share")
        + " ORDER BY distinct_order_count DESC, brand LIMIT 20",
        "tag_share_compare_top15": f"""WITH a AS ({_tag_summary("o_orderstatus = 'F'", "f_share")}),
            b AS ({_tag_summary("o_orderstatus IN ('O', 'P')", "other_share")}),
            j AS (SELECT coalesce(a.brand, b.brand) AS brand, coalesce(f_share, 0.0) AS f_share,
                         coalesce(other_share, 0.0) AS other_share
                  FROM a FULL OUTER JOIN b ON a.brand = b.brand)
            SELECT *, greatest(f_share, other_share) AS max_share FROM j
            ORDER BY max_share DESC, brand LIMIT 15""",
        "search_core": f"WITH {_TAGGED} SELECT * FROM shown WHERE {_CORE}",
        "search_summary": f"WITH {_TAGGED} SELECT {_SUMMARY} FROM shown WHERE {_CORE}",
        "search_extended": f"""WITH {_TAGGED} SELECT * FROM shown
            WHERE o_orderdate >= DATE '1997-01-01' AND contains(upper(vendor_clean), 'NATION_2')
              AND contains(upper(product_clean), 'BUILD')""",
        "search_empty": f"""WITH {_TAGGED} SELECT {_SUMMARY} FROM shown
            WHERE contains(upper(vendor_clean), 'NATION.*')""",
        "point_lookup": f"WITH {_TAGGED} SELECT * FROM shown WHERE o_orderkey = 17",
        "subset_monthly": f"""WITH {_TAGGED} SELECT added_month, count(*) AS record_count
            FROM shown WHERE {_CORE} GROUP BY 1""",
        "subset_vendors": f"""WITH {_TAGGED} SELECT vendor_clean,
            count(DISTINCT o_orderkey) AS record_count FROM shown WHERE {_CORE} GROUP BY 1""",
        "subset_tags": f"""WITH {_TAGGED}, f AS (SELECT o_orderkey FROM shown WHERE {_CORE})
            SELECT brand, count(DISTINCT o_orderkey) AS distinct_order_count
            FROM tl WHERE o_orderkey IN (SELECT o_orderkey FROM f) GROUP BY 1""",
        "case_candidates": f"WITH {_TAGGED}, {_CASES} SELECT * FROM top",
        "case_leaders": f"WITH {_TAGGED}, {_CASES} SELECT * FROM top",
        "query_cases_summary": f"""WITH {_TAGGED}, {_CASES}
            SELECT c.case_id, c.start_date, c.end_date, c.vendor, c.status, c.tag AS brand,
                   count(h.o_orderkey) AS record_count,
                   count(DISTINCT h.vendor_clean) AS vendor_count,
                   strftime(max(h.o_orderdate), '%Y-%m-%d') AS max_date,
                   count(*) FILTER (WHERE h.o_orderstatus = 'F') AS f_count,
                   'query_case_' || c.case_id || '.csv' AS output_file
            FROM cases c LEFT JOIN hits h ON c.case_id = h.case_id
            GROUP BY 1, 2, 3, 4, 5, 6""",
        "query_cases_rows": f"WITH {_TAGGED}, {_CASES} SELECT * FROM hits",
        "quality_summary": f"WITH {_RAW_LINES} " + " UNION ALL ".join([
            _check("KEV-SCHEMA-002", "true", "'6'", "6"),
            _zero_check("KEV-VAL-003", "SELECT count(*) FROM raw WHERE line_id IN (FROM rep)"),
            _zero_check("KEV-VAL-004", "SELECT count(*) FROM raw WHERE NOT "
                        "regexp_full_match(line_id, '[0-9]+-[0-9]+')"),
            _zero_check("KEV-VAL-005", "SELECT count(*) FROM raw WHERE o_orderdate IS NULL "
                        "OR l_shipdate IS NULL"),
            _zero_check("KEV-VAL-006", "SELECT count(*) FROM raw WHERE l_shipdate < o_orderdate"),
            _zero_check("KEV-VAL-007", f"SELECT count(*) FROM raw WHERE {_BAD_STATUS}",
                        '["A","R"]'),
            _zero_check("KEV-VAL-010", "SELECT count(*) FILTER (WHERE s_name IS NULL OR "
                        "trim(s_name) = '') + count(*) FILTER (WHERE p_name IS NULL OR "
                        "trim(p_name) = '') FROM raw"),
        ]),
        "quality_issues": f"WITH {_RAW_LINES} " + " UNION ALL ".join([
            _issue("KEV-VAL-003", "line_id", "line_id IN (FROM rep)"),
            _issue("KEV-VAL-006", "l_shipdate", "l_shipdate < o_orderdate"),
            _issue("KEV-VAL-007", "l_returnflag", _BAD_STATUS),
        ]),
        "quality_issues_tags": f"""WITH {_TAGGED}
            SELECT 'KEV-VAL-009' AS issue_code, 'ERROR' AS severity,
                   CAST(NULL AS BIGINT) AS row_index, o_orderkey, 'brands' AS field,
                   '[' || string_agg('"' || brand || '"', ',' ORDER BY brand) || ']'
                     AS observed_value,
                   '{quality.CHECKS["KEV-VAL-009"][2]}' AS message
            FROM tl WHERE NOT regexp_full_match(brand, 'Brand#[0-9]') GROUP BY o_orderkey""",
        "quality_counters": f"""WITH {_TAGGED}
            SELECT count(*) FILTER (WHERE brand_count = 0) AS empty_brand,
                   count(*) FILTER (WHERE has_brand) AS with_brand,
                   count(*) FILTER (WHERE has_brand AND o_orderstatus = 'F') AS f_with_brand,
                   count(*) FILTER (WHERE has_brand AND o_orderstatus IN ('O', 'P'))
                     AS other_with_brand,
                   count(*) FILTER (WHERE vendor_clean <> trim(vendor_clean))
                     AS vendor_whitespace,
                   count(*) FILTER (WHERE product_clean <> trim(product_clean))
                     AS product_whitespace
            FROM shown""",
        "field_profile": f"WITH {_RAW_LINES} " + " UNION ALL ".join(
            _profile(c, t) for c, t in (
                ("line_id", "string"), ("s_name", "string"), ("p_name", "string"),
                ("o_orderdate", "date"), ("l_shipdate", "date"), ("l_returnflag", "string"))
        ),
        "prepared": f"""WITH {_RAW_LINES}
            SELECT *, trim(s_name) AS vendor_clean, trim(p_name) AS product_clean,
                   CAST(year(o_orderdate) AS BIGINT) AS added_year,
                   strftime(o_orderdate, '%Y-%m') AS added_month,
                   CAST(date_diff('day', o_orderdate, l_shipdate) AS BIGINT) AS deadline_days
            FROM raw WHERE l_shipdate >= o_orderdate""",
        "rejected": f"""WITH {_RAW_LINES}
            SELECT *, '["l_shipdate precedes o_orderdate"]' AS reject_reasons
            FROM raw WHERE l_shipdate < o_orderdate""",
        "envelope_records": """
            SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS
                   o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
                   o_orderstatus, CAST(0 AS BIGINT) AS row_index
            FROM orders""",
        "envelope_metadata": """
            SELECT 'orders' AS title, strftime(o_orderdate, '%Y-%m-%d') AS "dateReleased",
                   count(*) AS declared, count(*) AS actual
            FROM orders GROUP BY 2""",
        "envelope_problems": """
            SELECT 'envelope' AS kind, CAST(0 AS BIGINT) AS n
            UNION ALL SELECT 'extra field', count(*) FROM orders""",
        "envelope_line_documents": """
            WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
            SELECT problem, document_count FROM (
              SELECT 'count is not BIGINT' AS problem, count(*) FILTER (WHERE k % 11 = 0)
                     AS document_count FROM k
              UNION ALL
              SELECT 'catalogVersion is missing', count(*) FILTER (WHERE k % 13 = 0) FROM k)
            WHERE document_count > 0""",
        "envelope_line_findings": f"""WITH {_LINE_RECORDS},
            f AS (
              SELECT 'not an object' AS kind, '' AS field FROM lr WHERE bare
              UNION ALL SELECT 'missing', 'l_partkey' FROM lr WHERE no_part
              UNION ALL SELECT 'extra', 'l_comment' FROM lr WHERE has_comment
              UNION ALL SELECT 'mistyped', 'l_suppkey' FROM lr WHERE bad_supplier
              UNION ALL SELECT 'mistyped', 'flags' FROM lr WHERE bad_flags)
            SELECT kind, field, count(*) AS record_count FROM f GROUP BY 1, 2""",
        "envelope_line_records": f"""WITH {_LINE_RECORDS}
            SELECT l_orderkey, l_suppkey, l_partkey, l_shipdate, l_returnflag, row_index,
                   CASE WHEN flag_1 IS NOT NULL
                        THEN '["' || flag_1 || '","' || flag_2 || '"]' END AS flags,
                   CASE WHEN bad_supplier AND bad_flags THEN 'flags,l_suppkey'
                        WHEN bad_supplier THEN 'l_suppkey' WHEN bad_flags THEN 'flags' END
                     AS mistyped
            FROM lr""",
        "tag_long_repeated_ids": f"""WITH {_LINE_RECORDS},
            p AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_returnflag,
                         l_suppkey AS vendor_clean, l_partkey AS product_clean, flag_1, flag_2
                  FROM lr WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL
                            AND flag_1 IS NOT NULL),
            e AS (SELECT DISTINCT l_orderkey, unnest([flag_1, flag_2]) AS flag, l_returnflag,
                         l_shipdate, vendor_clean, product_clean FROM p)
            SELECT l_orderkey, flag, l_returnflag, l_shipdate, vendor_clean, product_clean
            FROM e QUALIFY row_number() OVER (PARTITION BY l_orderkey, flag
                ORDER BY l_shipdate, l_returnflag, vendor_clean, product_clean) = 1""",
        "guard_findings": f"""WITH {_TAGGED},
            g AS (
              SELECT o_orderkey, o_orderdate IS NULL AS a, o_orderstatus IS NULL AS b,
                     coalesce(o_orderstatus NOT IN ('F', 'O'), false) AS c,
                     coalesce(added_month < '1995-06' OR added_month > '2000-12', false) AS d,
                     len(list_filter(string_split(trim(brands, '[]'), ','), lambda x:
                         x <> '' AND NOT regexp_full_match(x, '"Brand#[0-9]"'))) > 0 AS e
              FROM shown)
            SELECT v.guard, count(o_orderkey) AS row_count, min(o_orderkey) AS first_id
            FROM (VALUES ('opening day missing', 1), ('year missing', 1), ('status missing', 2),
                         ('status unsupported', 3), ('month outside period', 4),
                         ('tag list missing', 5), ('tag members invalid', 6)) AS v(guard, i)
            LEFT JOIN g ON CASE i WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c WHEN 4 THEN d
                                  WHEN 5 THEN false ELSE e END
            GROUP BY 1""",
        "table_fingerprint": _digest_sql("lineitem", {
            **dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "text"),
            **dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "float"),
            "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"}),
        "analysis_text": r"""
            WITH d AS (
              SELECT doc_id, regexp_replace(regexp_replace(text,
                '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''),
                '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') AS t
              FROM documents)
            SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS digest FROM d""",
        "text_term_stats": f"WITH {terms} SELECT * FROM stats",
        "text_vocabulary": f"""WITH {terms}
            SELECT * FROM stats
            WHERE doc_count >= 2 AND doc_count <= 0.95 * (SELECT count(*) FROM documents)
            ORDER BY term_count DESC, term LIMIT 5000""",
        "text_weights": f"""WITH {terms},
            d AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
            vocab AS (
              SELECT term, doc_count FROM stats, d WHERE doc_count >= 2 AND doc_count <= 0.95 * n
              ORDER BY term_count DESC, term LIMIT 5000),
            tf AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY 1, 2),
            raw AS (
              SELECT doc_id, term, (1 + ln(c)) * (ln((1 + n) / (1 + doc_count)) + 1) AS w
              FROM tf JOIN vocab USING (term), d)
            SELECT doc_id, term,
                   round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
            FROM raw""",
        "cluster_checks": """
            SELECT 'candidates' AS check_name, CAST(5 AS BIGINT) AS value
            UNION ALL SELECT 'selected', 1
            UNION ALL SELECT 'documents', count(*) FROM documents
            UNION ALL SELECT 'ids', count(DISTINCT doc_id) FROM documents
            UNION ALL SELECT 'members', count(*) FROM documents
            UNION ALL SELECT 'known', count(*) FROM documents
              WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
            UNION ALL SELECT 'share in millionths', 1000000
            UNION ALL SELECT 'fewest keywords', 10
            UNION ALL SELECT 'most keywords', 10""",
    }
