import json

import pytest

from rolecall.operators.quality import field_profile
from pyspark.sql import functions as F

from rolecall.errors import RecordMismatch
from rolecall.operators import quality
from rolecall.operators.prepare import prepare
from rolecall.sources.envelope import read_envelope
from rolecall.spec import VULNERABILITY_FEED as FEED
from tests.frames import raw_frame, raw_row
from tests.test_envelope import as_records, document, write


def clean_rows(n=12):
    return [raw_row(f"CVE-2024-{1000 + i}", tags=["CWE-79"]) for i in range(n)]


def change(row, **cells):
    values = dict(zip(FEED.raw_fields, row, strict=True)) | cells
    return tuple(values[f] for f in FEED.raw_fields)


def metadata(spark, count):
    return spark.createDataFrame([(count,)], "count bigint")


def found(report):
    return {
        (r.issue_code, r.row_index, r.field) for r in report.issues.collect() if r.field is not None
    }


def checks(report):
    return {r.check_id: (r.passed, r.actual) for r in report.summary.collect()}


def test_clean_input_is_valid(spark):
    df = raw_frame(spark, clean_rows())
    report = quality.validate(df, FEED, metadata(spark, 12))
    assert report.is_valid() and report.issues.count() == 0
    ids = [r.check_id for r in report.summary.collect()]
    assert ids == sorted(ids) and "KEV-VAL-001" in ids and "KEV-VAL-011" not in ids


def dirty_rows():
    rows = clean_rows(16)
    rows[0] = change(rows[0], cveID=rows[1][0])
    rows[2] = change(rows[2], dateAdded="2026-99-01")
    rows[3] = change(rows[3], dueDate="2000-01-01")
    rows[4] = change(rows[4], knownRansomwareCampaignUse="No")
    rows[5] = change(rows[5], cwes="CWE-79")
    rows[6] = change(rows[6], cwes=["79"])
    rows[7] = change(rows[7], vendorProject="   ")
    rows[8] = change(rows[8], cveID="CVE-24-1")
    rows[9] = change(rows[9], cwes=["CWE-79\n", "CWE-5"])
    rows[10] = change(rows[10], dateAdded="2026-02-30")
    rows[11] = change(rows[11], dateAdded="2026-2-3", dueDate="x")
    rows[12] = change(rows[12], vendorProject="\tAcme ")
    rows[13] = change(rows[13], cveID="")
    return rows


EXPECTED = {
    ("KEV-VAL-003", 0, "cveID"), ("KEV-VAL-003", 1, "cveID"), ("KEV-VAL-003", 13, "cveID"),
    ("KEV-VAL-004", 8, "cveID"), ("KEV-VAL-004", 13, "cveID"),
    ("KEV-VAL-005", 2, "dateAdded"), ("KEV-VAL-005", 10, "dateAdded"),
    ("KEV-VAL-005", 11, "dateAdded"), ("KEV-VAL-005", 11, "dueDate"),
    ("KEV-VAL-006", 3, "dueDate"),
    ("KEV-VAL-007", 4, "knownRansomwareCampaignUse"),
    ("KEV-VAL-008", 5, "cwes"),
    ("KEV-VAL-009", 6, "cwes"), ("KEV-VAL-009", 9, "cwes"),
    ("KEV-VAL-010", 7, "vendorProject"),
}


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    path = write(tmp_path_factory.mktemp("dirty"), document(as_records(dirty_rows()), count=99))
    return read_envelope(spark, path)


@pytest.fixture(scope="module")
def dirty_report(dirty):
    counters = {"empty_cwe": 0, "with_cwe": 15, "known_with_cwe": 0, "unknown_with_cwe": 0,
                "vendor_whitespace": 2, "product_whitespace": 0}
    spec = FEED.with_options(expected_rows=16, expected_counters=counters)
    return quality.validate(dirty.records, spec, dirty.metadata)


def test_every_rule_finds_its_row(dirty_report):
    assert found(dirty_report) == EXPECTED
    assert not dirty_report.is_valid()


def test_counts_of_the_checks(dirty_report):
    got = checks(dirty_report)
    assert got["KEV-SCHEMA-002"] == (True, "11")
    assert got["KEV-VAL-001"] == (False, '{"metadata_count":99,"rows":16}')
    assert got["KEV-VAL-002"] == (True, "16")
    wanted = {"003": "3", "004": "2", "005": "3", "006": "1", "007": "1", "008": "1", "009": "2",
              "010": "1"}
    for code, count in wanted.items():
        assert got[f"KEV-VAL-{code}"] == (False, count)
    passed, actual = got["KEV-VAL-011"]
    assert not passed
    assert json.loads(actual) == {
        "empty_cwe": 0, "with_cwe": 15, "known_with_cwe": 0, "unknown_with_cwe": 14,
        "vendor_whitespace": 2, "product_whitespace": 0,
    }


def test_searching_only_failed_checks_finds_the_same(dirty, dirty_report):
    failed = [r.check_id for r in dirty_report.summary.collect() if not r.passed]
    some = quality.issues(dirty.records, FEED, codes=failed)
    rows = {(r.issue_code, r.row_index, r.field) for r in some.collect()}
    assert rows == EXPECTED
    one = quality.issues(dirty.records, FEED, codes=["KEV-VAL-008"])
    assert [(r.issue_code, r.row_index) for r in one.collect()] == [("KEV-VAL-008", 5)]
    none = quality.issues(dirty.records, FEED, codes=[])
    assert none.count() == 0 and none.columns == quality.issue_columns(FEED)


def test_observed_values_and_order(dirty_report):
    rows = dirty_report.issues.collect()
    seen = {(r.issue_code, r.row_index, r.field): r.observed_value for r in rows}
    assert seen[("KEV-VAL-008", 5, "cwes")] == '"CWE-79"'
    assert json.loads(seen[("KEV-VAL-009", 9, "cwes")]) == ["CWE-79\n"]
    assert [r.issue_code for r in rows[:2]] == ["KEV-VAL-001", "KEV-VAL-011"]
    keys = [(r.severity != "FATAL", r.issue_code, r.row_index is None, r.row_index or 0)
            for r in rows]
    assert keys == sorted(keys)


def test_wrong_fields_stop_the_row_checks(spark):
    df = raw_frame(spark, clean_rows()).select("product", *[f for f in FEED.raw_fields if f != "product"])
    report = quality.validate(df, FEED, metadata(spark, 12))
    assert [r.check_id for r in report.summary.collect()] == ["KEV-SCHEMA-002", "KEV-VAL-001"]
    assert [r.issue_code for r in report.issues.collect()] == ["KEV-SCHEMA-002"]
    assert report.profile.count() == 11 and not report.is_valid()


def test_null_ids_are_blank_not_repeated(spark):
    rows = [change(r, cveID=None) for r in clean_rows(3)] + clean_rows(1)
    report = quality.validate(raw_frame(spark, rows), FEED)
    blank = [i for c, i, _ in found(report) if c == "KEV-VAL-003"]
    assert sorted(blank) == [0, 1, 2]
    assert checks(report)["KEV-VAL-003"] == (False, "3")


def test_repeated_id_may_hold_most_rows(spark):
    rows = [change(r, cveID="CVE-2024-7777") for r in clean_rows(40)] + clean_rows(20)
    report = quality.validate(raw_frame(spark, rows), FEED)
    assert sorted(i for c, i, _ in found(report) if c == "KEV-VAL-003") == list(range(40))
    assert checks(report)["KEV-VAL-003"] == (False, "40")


def test_profile(spark):
    rows = clean_rows(4)
    long = "x" * 500
    rows[0] = change(rows[0], vendorProject=None, cwes=None, shortDescription=long)
    rows[1] = change(rows[1], vendorProject=" \t", cwes=[], shortDescription=long + "y")
    rows[2] = change(rows[2], cwes=[], shortDescription=long)
    got = {r.field: r for r in quality.field_profile(raw_frame(spark, rows)).collect()}
    assert list(got) == sorted(FEED.raw_fields)
    v, t, d = got["vendorProject"], got["cwes"], got["shortDescription"]
    assert (v.row_count, v.non_null_count, v.null_count, v.empty_string_count, v.unique_count) == (
        4, 3, 1, 1, 2)
    assert (t.non_null_count, t.null_count, t.empty_string_count, t.unique_count) == (3, 1, 0, 2)
    assert d.unique_count == 3 and t.dtype == "array<string>"


def test_prepare_derives_and_quarantines(spark):
    rows = clean_rows(6)
    rows[0] = change(rows[0], vendorProject=" Acme \t", cwes=["CWE-1", "CWE-1"])
    rows[1] = change(rows[1], cwes=None)
    rows[2] = change(rows[2], dueDate="2000-01-01")
    rows[3] = change(rows[3], dateAdded="2024-13-01")
    rows[4] = change(rows[4], product=None)
    good, rejected = prepare(raw_frame(spark, rows), FEED)
    assert tuple(good.columns) == FEED.prepared_fields
    first = good.filter(F.col("cveID") == "CVE-2024-1000").first()
    assert (first.vendorProject, first.vendor_clean) == (" Acme \t", "Acme")
    assert (first.added_year, first.added_month, first.deadline_days) == (2024, "2024-01", 21)
    assert (first.has_cwe, first.cwe_count) == (True, 2)
    assert good.count() == 2
    reasons = {r.row_index: r.reject_reasons for r in rejected.collect()}
    assert sorted(reasons) == [1, 2, 3, 4]
    assert reasons[2] == ["dueDate precedes dateAdded"]
    with pytest.raises(RecordMismatch) as err:
        prepare(raw_frame(spark, rows), FEED, mode="fail")
    assert sorted(i for i, _ in err.value.context["rows"]) == [1, 2, 3, 4]
    with pytest.raises(RecordMismatch):
        prepare(raw_frame(spark, rows).drop("notes"), FEED)


def test_profile_takes_values_literally(spark):
    df = spark.createDataFrame([("blank-sha256:note",), ("x",), ("  ",), (None,)], "note string")
    row = field_profile(df).first()
    assert (row.empty_string_count, row.unique_count, row.null_count) == (1, 3, 1)


def test_fingerprint_sees_moved_nulls_and_list_members(spark):
    from rolecall.plans.publish import fingerprint

    schema = "a string, b string, c array<string>, d array<string>"
    one = spark.createDataFrame([("x", None, ["p", "q"], ["r"])], schema)
    moved = spark.createDataFrame([(None, "x", ["p", "q"], ["r"])], schema)
    traded = spark.createDataFrame([("x", None, ["p"], ["q", "r"])], schema)
    assert len({fingerprint(f).first().fingerprint for f in (one, moved, traded)}) == 3
