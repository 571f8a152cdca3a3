import pytest
from pyspark.sql import functions as F

from rolecall.errors import RecordMismatch, SourceEncoding, SourceMalformed, StatisticsInput
from rolecall.operators import cases, guards, prepare
from rolecall.sources import envelope
from rolecall.spec import VULNERABILITY_FEED as FEED
from tests.frames import CATALOG_ROWS, prepared_frame, raw_frame, raw_row

ROWS = [
    raw_row("CVE-2021-0002", opened="2021-05-04", due="2021-05-09", tags=["CWE-1"]),
    raw_row("CVE-2021-0001", opened="2023-02-01", due="2023-02-03", status="Perhaps"),
    raw_row("CVE-2021-0003", opened="2021-06-04", due="2021-06-09", status=None, tags=["x", None]),
]


def found(df, spec):
    return {r.guard: (r.row_count, r.first_id) for r in guards.findings(df, spec).collect()}


def test_findings_count_and_name_the_smallest_id(spark):
    spec = FEED.with_options(period_start="2021-05", period_end="2022-12")
    got = found(prepared_frame(spark, ROWS), spec)
    assert got == {
        "opening day missing": (0, None), "year missing": (0, None),
        "status missing": (1, "CVE-2021-0003"), "status unsupported": (1, "CVE-2021-0001"),
        "month outside period": (1, "CVE-2021-0001"),
        "window missing": (0, None), "window negative": (0, None),
        "tag list missing": (0, None), "tag members invalid": (1, "CVE-2021-0003"),
    }


def test_findings_of_an_empty_catalog_are_zero(spark):
    assert set(found(prepared_frame(spark, []), FEED).values()) == {(0, None)}


def test_counts_agree_with_findings_and_are_required(spark):
    df = prepared_frame(spark, ROWS)
    counted = df.agg(*guards.counts(FEED)).first().asDict()
    assert counted == {name: n for name, (n, _) in found(df, FEED).items()}
    with pytest.raises(RecordMismatch):
        guards.require(counted)
    with pytest.raises(StatisticsInput):
        guards.require({"status missing": 2, "tag list missing": 0})
    guards.require({"status missing": 0})


def test_prepare_without_label_roles(spark):
    spec = FEED.with_options(vendor=None, product=None, fields=("cveID", "dateAdded", "dueDate"))
    spec = spec.with_options(tags=None)
    prepared, rejected = prepare.prepare(raw_frame(spark, CATALOG_ROWS, index=False), spec)
    assert tuple(prepared.columns) == spec.prepared_fields
    assert prepared.columns[3:] == ["added_year", "added_month", "deadline_days"]
    assert (prepared.count(), rejected.count()) == (len(CATALOG_ROWS), 0)


def test_leaders_in_one_scan_equal_those_of_a_branch_a_kind(spark):
    rows = [*CATALOG_ROWS,
            raw_row("CVE-2020-9000", "Heron Labs", opened="2020-07-01", due="2020-07-02",
                    status="Known", tags=[]),
            raw_row("CVE-2021-9001", "Ant", opened="2021-07-01", due="2021-07-02", tags=["CWE-22"]),
            raw_row("CVE-2021-9002", "Ant", opened="2021-07-01", due="2021-07-02",
                    tags=["CWE-502", "CWE-502", None])]
    df = prepared_frame(spark, rows)
    one = sorted(map(tuple, cases.leaders(df, FEED).collect()))
    three = sorted(map(tuple, cases.top_candidates(df, FEED, unique_ids=False).collect()))
    assert one == three and [r[0] for r in one] == [1, 2, 3]


def test_leaders_read_the_records_once(spark, tmp_path):
    prepared_frame(spark, CATALOG_ROWS).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = cases.leaders(df, FEED)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1


def test_leaders_of_no_records(spark):
    assert cases.leaders(prepared_frame(spark, []), FEED).count() == 0


def test_broken_bytes_of_line_files_are_an_encoding_error(spark, tmp_path):
    head = b'{"title":"t","catalogVersion":"1","dateReleased":"d","count":0,"vulnerabilities":[]}\n'
    bad = tmp_path / "bad.jsonl"
    bad.write_bytes(head + b'{"title":"\xff\xfe"\n')
    with pytest.raises(SourceEncoding):
        envelope.read_envelope(spark, str(bad), one_per_line=True)
    text = tmp_path / "text.jsonl"
    text.write_bytes(head + b'{"title":\n')
    with pytest.raises(SourceMalformed):
        envelope.read_envelope(spark, str(text), one_per_line=True)


def test_publishing_counts_guards_while_it_writes(spark, tmp_path):
    from rolecall.plans.publish import Publisher
    from rolecall.plans.registry import registry

    out = Publisher(spark, str(tmp_path / "run-a"))
    table = registry(FEED)[f"{FEED.name}_prepared"]
    seen = {}
    df = prepared_frame(spark, ROWS).repartition(3).filter(F.col("cveID") != "")
    out.write(df, table, guards.counts(FEED), seen.update)
    assert (seen["status missing"], seen["tag members invalid"], seen["window negative"]) == (1, 1, 0)
    with pytest.raises(RecordMismatch):
        out.write(df, table, guards.counts(FEED), guards.require)
