"""Search, tags, subsets and cases beside plain Python over the same few rows."""

from collections import Counter
from datetime import date, datetime, timedelta, timezone
from itertools import product

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolecall.errors import BadDateRange, BadStatus, BadTag, MissingColumns, RecordMismatch
from rolecall.operators import cases, subsets, tags
from rolecall.operators.search import by_id, search
from rolecall.spec import VULNERABILITY_FEED as FEED
from tests.frames import CATALOG_ROWS, ids_of, prepared_frame, raw_row, rows_of

RECORDS = [
    {"id": r[0], "vendor": r[1].strip(), "product": r[2].strip(), "opened": r[4], "status": r[8],
     "tags": set(r[10])}
    for r in CATALOG_ROWS
]


def brute(start=None, end=None, vendor=None, product=None, status=None, tag=None):
    """Records that meet all conditions, latest first, then by id."""
    found = [
        r for r in RECORDS
        if (not start or r["opened"] >= start) and (not end or r["opened"] <= end)
        and (not vendor or vendor.strip().upper() in r["vendor"].upper())
        and (not product or product.strip().upper() in r["product"].upper())
        and (not status or r["status"] == status)
        and (not tag or not tag.strip() or tag.strip().upper() in r["tags"])
    ]
    found.sort(key=lambda r: r["id"])
    return sorted(found, key=lambda r: r["opened"], reverse=True)


def totals(found):
    latest = max((r["opened"] for r in found), default=None)
    return (len(found), len({r["vendor"] for r in found}), latest and date.fromisoformat(latest),
            sum(r["status"] == "Known" for r in found))


@pytest.fixture(scope="module")
def catalog(spark):
    return prepared_frame(spark, CATALOG_ROWS).cache()


# --- search ---

LABELS = [
    dict(zip(("vendor", "product", "status", "tag"), values, strict=True))
    for values in product((None, " QUILL", "osprey"), (None, "ledger"), (None, "Known", "Unknown"),
                          (None, "cwe-22 "))
]
PERIODS = [
    {"start": "2020-04-02"}, {"start": "2020-04-03"}, {"end": "2021-06-30"}, {"end": "2019-12-31"},
    {"start": "2021-01-11", "end": "2021-06-30"}, {"start": "2021-06-30", "end": "2021-06-30"},
    {"start": "2021-01-01", "tag": "CWE-22"}, {"vendor": "  ", "product": "", "tag": " "},
    {"product": ".*"}, {"product": "k.*"}, {"vendor": "&"}, {"tag": "CWE-2"},
]


@pytest.mark.parametrize("criteria", LABELS + PERIODS, ids=str)
def test_conditions_equal_brute_force(catalog, criteria):
    given = {{"start": "start_date", "end": "end_date"}.get(k, k): v for k, v in criteria.items()}
    rows, summary = search(catalog, FEED, **given)
    want = brute(**criteria)
    assert ids_of(rows) == [r["id"] for r in want]
    assert rows.columns == list(FEED.prepared_fields)
    assert rows_of(summary) == [totals(want)]
    assert summary.columns == ["record_count", "vendor_count", "max_date", "known_count"]


@pytest.mark.parametrize("day", [
    date(2021, 6, 30),
    datetime(2021, 6, 30, 0, 1, tzinfo=timezone(timedelta(hours=9))),
    pd.Timestamp("2021-06-30T23:59:59.5"),
    "2021-06-30 08:00",
], ids=str)
def test_a_day_may_come_in_several_types(catalog, day):
    """The calendar day counts as written, whatever the time and the zone."""
    both = search(catalog, FEED, start_date=day, end_date=day)[0]
    assert ids_of(both) == ["CVE-2021-1501", "CVE-2021-1502"]


REFUSED = {
    BadDateRange: [{"start_date": "2022-02-30"}, {"end_date": float("nan")},
                   {"start_date": "2021-07-01", "end_date": "2021-06-30"}],
    BadStatus: [{"status": "unknown"}, {"status": " Known"}],
    BadTag: [{"tag": "CWE"}, {"tag": "CWE-22,CWE-502"}],
    TypeError: [{"vendor": 22}, {"product": ["Nest"]}, {"tag": 22}],
}


@pytest.mark.parametrize("error, fields", [(e, f) for e, many in REFUSED.items() for f in many])
def test_refused_arguments(catalog, error, fields):
    with pytest.raises(error):
        search(catalog, FEED, **fields)


def test_the_first_fault_is_reported(catalog):
    """Columns come before arguments, days before status, status before tag."""
    faults = {"start_date": "soon", "status": "?", "tag": "?"}
    for error in (BadDateRange, BadStatus, BadTag):
        with pytest.raises(error):
            search(catalog, FEED, **faults)
        faults.pop(next(iter(faults)))
    with pytest.raises(MissingColumns):
        search(catalog.drop("cwes"), FEED, start_date="soon")


def test_all_rows_without_a_list_are_reported(spark, catalog):
    listless = prepared_frame(spark, [raw_row(f"CVE-2019-{1000 + i}") for i in range(25)])
    listless = listless.withColumn("cwes", F.lit(None).cast("array<string>"))
    both = catalog.unionByName(listless)
    with pytest.raises(MissingColumns) as err:
        search(both, FEED, tag="CWE-22")
    assert err.value.context["count"] == 25 and len(err.value.context["rows"]) == 20
    stored = spark.read.parquet(err.value.context["stored"])
    assert sorted(ids_of(stored)) == [f"CVE-2019-{1000 + i}" for i in range(25)]
    assert search(both, FEED, vendor="osprey")[0].count() == 2  # no tag, no need of lists


def test_point_lookup(catalog):
    for r in RECORDS:
        assert ids_of(by_id(catalog, FEED, r["id"])) == [r["id"]]
    assert by_id(catalog, FEED, "CVE-2020-7").count() == 0


def test_year_bounds_prune_partitions(spark, catalog, tmp_path):
    catalog.write.partitionBy("added_year").parquet(str(tmp_path / "by_year"))
    stored = spark.read.parquet(str(tmp_path / "by_year")).select(*FEED.prepared_fields)
    rows, _ = search(stored, FEED, start_date="2021-03-01", end_date="2021-12-31")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "added_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows.count() == 2


# --- tags ---


def long_rows():
    return {(r["id"], t) for r in RECORDS for t in r["tags"]}


@pytest.mark.parametrize("unique", [True, False])
def test_long_table_holds_each_tag_of_a_record_once(catalog, unique):
    long = tags.long_table(catalog, FEED, unique_ids=unique, check=True)
    assert long.columns == ["cveID", "cwe", "knownRansomwareCampaignUse", "dateAdded",
                            "vendor_clean", "product_clean"]
    got = [(r.cveID, r.cwe) for r in tags.in_order(long, FEED).collect()]
    assert got == sorted(long_rows())


def test_of_repeated_ids_the_first_row_is_kept(spark):
    makers = ("Wren", "Auk", "Lark")
    rows = [raw_row("CVE-2018-3003", m, tags=["CWE-9"] + ["CWE-8"] * (m != "Wren")) for m in makers]
    df = prepared_frame(spark, rows)
    index = F.array_position(F.array(*map(F.lit, makers)), F.col("vendor_clean"))
    long = tags.long_table(df.withColumn("row_index", index), FEED)
    assert sorted((r.cwe, r.vendor_clean) for r in long.collect()) == [
        ("CWE-8", "Auk"), ("CWE-9", "Wren")]


def brute_shares(status=None):
    mine = [r for r in RECORDS if r["tags"] and status in (None, r["status"])]
    counts = Counter(t for r in mine for t in r["tags"])
    return {t: (n, len(mine), n / len(mine)) for t, n in counts.items()}


def test_shares_equal_brute_force(catalog):
    got = tags.analyze(catalog, FEED)
    shares = {}
    for table, status in ((got.overall, None), (got.positive, "Known"), (got.other, "Unknown")):
        shares[status] = brute_shares(status)
        assert {r[0]: tuple(r)[1:] for r in table.collect()} == shares[status]
    names = set(shares["Known"]) | set(shares["Unknown"])
    pairs = {t: tuple(shares[s].get(t, (0, 0, 0.0))[2] for s in ("Known", "Unknown")) for t in names}
    best = sorted(names, key=lambda t: (-max(pairs[t]), t))[:2]
    compared = tags.compare_shares(got.positive, got.other, FEED, 2)
    assert rows_of(compared) == [(t, *pairs[t], max(pairs[t])) for t in best]
    by_count = sorted(shares[None], key=lambda t: (-shares[None][t][0], t))
    assert [r.cwe for r in tags.top_tags(got.overall, FEED, 2).collect()] == by_count[:2]


def test_stated_denominators(catalog):
    spec = FEED.with_options(tag_denominators={"overall": 50, "Known": 8, "Unknown": 16})
    got = tags.analyze(catalog, spec)
    for table, status, n in ((got.overall, None, 50), (got.positive, "Known", 8),
                             (got.other, "Unknown", 16)):
        want = {t: (c, n, c / n) for t, (c, _, _) in brute_shares(status).items()}
        assert {r[0]: tuple(r)[1:] for r in table.collect()} == want


def test_tag_guards(spark, catalog):
    untagged = catalog.filter(F.size("cwes") == 0)
    long = tags.long_table(untagged, FEED)
    assert long.count() == 0 and len(long.columns) == 6
    for bad in (["CWE-22", "cwe-22"], [None, "CWE-1"], ["CWE-5 "], [""]):
        df = prepared_frame(spark, [raw_row("CVE-2018-3004", tags=bad)])
        with pytest.raises(RecordMismatch, match="members"):
            tags.long_table(df, FEED, check=True)
    with pytest.raises(RecordMismatch, match="list"):
        tags.analyze(untagged.withColumn("cwes", F.lit(None).cast("array<string>")), FEED)
    with pytest.raises(RecordMismatch, match="status"):
        tags.analyze(catalog.withColumn("knownRansomwareCampaignUse", F.lit("?")), FEED)


# --- subsets ---


@pytest.mark.parametrize("copies", [1, 2])
def test_subsets_count_ids_once(catalog, copies):
    df = catalog
    for _ in range(copies - 1):
        df = df.union(catalog)
    leaders = Counter(r["vendor"] for r in RECORDS)
    want = sorted(leaders.items(), key=lambda x: (-x[1], x[0]))
    assert rows_of(subsets.vendors(df, FEED)) == want
    found = Counter(t for _, t in long_rows())
    assert rows_of(subsets.tags(df, FEED)) == sorted(found.items(), key=lambda x: (-x[1], x[0]))


def test_subset_months(catalog):
    months = Counter(r["opened"][:7] for r in RECORDS)
    assert rows_of(subsets.monthly(catalog)) == sorted(months.items())
    nothing = catalog.limit(0)
    assert subsets.monthly(nothing).count() == 0
    assert subsets.vendors(nothing, FEED).columns == ["vendor_clean", "record_count"]
    with pytest.raises(MissingColumns):
        subsets.monthly(catalog.drop("added_month"))


# --- cases ---


def test_default_cases_follow_the_most_frequent_pairs(catalog):
    result = cases.run_cases(catalog, FEED)
    assert result.summary.columns == [
        "case_id", "start_date", "end_date", "vendor", "ransomware", "cwe", "record_count",
        "vendor_count", "max_date", "known_count", "output_file",
    ]
    # Known records by (year, vendor); all by (vendor, tag); Unknown ones by (year, tag), where
    # every pair occurs once and the earliest year leads.
    assert rows_of(result.summary) == [
        (1, "2020-01-01", "2020-12-31", "Heron Labs", "Known", None, 2, 1, "2020-04-02", 2,
         "query_case_1.csv"),
        (2, None, None, "Heron Labs", None, "CWE-22", 2, 1, "2020-04-02", 2, "query_case_2.csv"),
        (3, "2020-01-01", "2020-12-31", None, "Unknown", "CWE-502", 1, 1, "2020-09-21", 0,
         "query_case_3.csv"),
    ]
    assert ids_of(result.rows_of(1, FEED)) == ["CVE-2020-7001", "CVE-2020-7002"]
    assert result.rows_of(3, FEED).columns == list(FEED.prepared_fields)
    assert cases.default_cases(catalog, FEED) == cases.default_cases(catalog, FEED, unique_ids=True)


def stated(case_id, **fields):
    return dict.fromkeys(("start_date", "end_date", "vendor", "status", "tag")) | fields | {
        "case_id": case_id}


def test_stated_cases_equal_searches(catalog):
    wanted = {31: {"vendor": "s"}, 5: {"vendor": "gannet"}, 12: {"status": "Unknown", "tag": "cwe-22"}}
    result = cases.run_cases(catalog, FEED, [stated(str(i), **f) for i, f in wanted.items()])
    summary = result.summary.collect()
    assert [r.case_id for r in summary] == [5, 12, 31]
    for r in summary:
        want = brute(**wanted[r.case_id])
        assert ids_of(result.rows_of(r.case_id, FEED)) == [x["id"] for x in want]
        assert (r.record_count, r.vendor_count, r.known_count) == (
            totals(want)[0], totals(want)[1], totals(want)[3])


def test_case_arguments(catalog):
    three = [stated(i) for i in (1, 2, 3)]
    by_label = [{"ransomware" if k == "status" else "cwe" if k == "tag" else k: v
                 for k, v in c.items()} for c in three]
    assert cases.normalize_cases(by_label, FEED) == cases.normalize_cases(three, FEED)
    short = {k: v for k, v in three[2].items() if k != "vendor"}
    for bad in (three[:2], [*three, stated(2)], [*three[:2], stated(-3)], [*three[:2], short]):
        with pytest.raises(ValueError):
            cases.run_cases(catalog, FEED, bad)
    with pytest.raises(BadStatus):
        cases.run_cases(catalog, FEED, [*three, stated(4, status="open")])


def test_default_cases_need_records_of_each_kind(catalog):
    known = F.col("knownRansomwareCampaignUse") == "Known"
    for df, said in ((catalog.limit(0), "no records"), (catalog.filter(~known), "Known"),
                     (catalog.filter(F.size("cwes") == 0), "tag"), (catalog.filter(known), "Unknown")):
        with pytest.raises(RecordMismatch, match=said):
            cases.default_cases(df, FEED)
