import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from rolecall.errors import OutputMismatch
from rolecall.operators import quality
from rolecall.plans.publish import Publisher, fingerprint, source_digest, verify
from rolecall.plans.registry import OutputTable, missing_outputs, registry, required_outputs
from rolecall.plans.run import RunConfig, check_complete, run, run_core, run_data_core
from rolecall.session import checkpoint_root
from rolecall.sources.records import read_table_csv
from rolecall.spec import VULNERABILITY_FEED as FEED
from tests.frames import RAW_SCHEMA, prepared_frame, raw_row
from tests.test_envelope import as_records, document, write
from tests.test_statistics import random_rows

WORDS = ("remote code execution", "cross site scripting", "privilege escalation", "sql injection")


def catalog_rows():
    rows = []
    for i, row in enumerate(random_rows(11, 90)):
        cells = dict(zip(FEED.raw_fields, row, strict=True))
        tags = [f"CWE-{t}" for t in (79, 89, 787) if (i + t) % 3 == 0] + (["CWE-20"] if i % 2 else [])
        cells |= {"cwes": tags, "shortDescription": f"{WORDS[i % 4]} in component {i % 7}",
                  "vulnerabilityName": f"{WORDS[i % 4]} issue"}
        rows.append(tuple(cells[f] for f in FEED.raw_fields))
    return rows


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    return write(tmp_path_factory.mktemp("feed"), document(as_records(catalog_rows())))


@pytest.fixture(scope="module")
def complete(spark, feed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("out"))
    return run(spark, RunConfig(feed, root, n_init=1, candidate_k=(2, 3)))


def read(spark, result, name):
    return spark.read.parquet(f"{result.root}/{registry(FEED)[name].path}")


def test_complete_run_publishes_every_table(spark, complete, feed):
    assert complete.status == "complete"
    manifest = complete.manifest.collect()
    singles = set(registry(FEED)) - {"query_case"}
    others = {"metadata", "query_case_1", "query_case_2", "query_case_3"}
    assert {r.name for r in manifest} == singles | others and len(manifest) == 29
    assert {r.input_digest for r in manifest} == {hashlib.sha256(open(feed, "rb").read()).hexdigest()}
    for r in manifest:
        assert r.bytes > 0
        if r.name in others:
            continue
        table = registry(FEED)[r.name]
        stored = spark.read.parquet(f"{complete.root}/{table.path}")
        assert sorted(stored.columns) == sorted(table.columns)
        got = fingerprint(stored.select(*[f"`{c}`" for c in table.columns])).first()
        assert (got.row_count, got.fingerprint) == (r.row_count, r.fingerprint), r.name
        assert list(r.columns) == list(table.columns)
    written = spark.read.json(f"{complete.root}/manifests/run_manifest")
    assert written.count() == 29


def test_published_tables_agree_with_each_other(spark, complete):
    total = read(spark, complete, "kev_prepared").count()
    assert total == 90
    for name, column in (("monthly_added_counts", "record_count"), ("vendor_summary", "record_count"),
                         ("ransomware_summary", "record_count"), ("ml_cluster_summary", "record_count"),
                         ("deadline_frequency", "record_count"), ("annual_added_summary", "record_count")):
        assert read(spark, complete, name).agg(F.sum(column)).first()[0] == total, name
    cases = read(spark, complete, "query_cases_summary").collect()
    assert [r.case_id for r in cases] == [1, 2, 3]
    for r in cases:  # each case lies under the name that the summary states
        rows = spark.read.csv(f"{complete.root}/queries/{r.output_file}", header=True)
        assert rows.count() == r.record_count > 0 and rows.columns == list(FEED.prepared_fields)
    vendors = [tuple(r) for r in read(spark, complete, "vendor_summary").collect()]
    assert vendors == sorted(vendors, key=lambda r: (-r[1], r[0]))
    metadata = spark.read.json(f"{complete.root}/validation/metadata").first()
    assert metadata["count"] == 90 and metadata.actualRecordCount == 90


def test_prepared_table_prunes_by_year(spark, complete):
    stored = read(spark, complete, "kev_prepared")
    plan = stored.filter("added_year = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "added_year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_invalid_input_publishes_only_quality(spark, tmp_path):
    rows = catalog_rows()
    rows[0] = raw_row("CVE-2024-1", status="No")
    source = write(tmp_path, document(as_records(rows)))
    result = run(spark, RunConfig(source, str(tmp_path / "out"), clustering=False))
    assert result.status == "validation_failed"
    names = {r.name for r in result.manifest.collect()}
    assert names == {"metadata", "validation_summary", "validation_details", "field_profile"}
    assert sorted(p.name for p in (tmp_path / "out").glob("run-*/*")) == ["manifests", "validation"]
    details = read(spark, result, "validation_details")
    assert {r.issue_code for r in details.collect()} == {"KEV-VAL-004", "KEV-VAL-007"}


def test_each_run_has_its_own_folder(spark, feed, tmp_path):
    config = RunConfig(feed, str(tmp_path), clustering=False)
    first, _, _ = run_core(spark, config)
    second, prepared, _ = run_core(spark, config)
    assert first.root != second.root and prepared.count() == 90


def test_a_second_run_leaves_nothing_stale(spark, feed, tmp_path):
    config = RunConfig(feed, str(tmp_path / "out"), clustering=False, run_id="same")
    first = run(spark, config)
    kept = tmp_path / "out/run-same/tables/own_notes.txt"
    kept.write_text("not ours")
    rows = catalog_rows()
    rows[3] = raw_row("CVE-2024-1003", status="No")
    broken = write(tmp_path, document(as_records(rows)), "broken.json")
    second = run(spark, RunConfig(broken, str(tmp_path / "out"), clustering=False, run_id="same"))
    assert (second.root, second.status) == (first.root, "validation_failed")
    left = {str(p.relative_to(first.root)) for p in (tmp_path / "out/run-same").glob("*/*")}
    assert left == {"manifests/run_manifest", "tables/own_notes.txt", "validation/metadata",
                    "validation/validation_summary", "validation/validation_details",
                    "validation/field_profile"}
    assert not [p for p in os.listdir(checkpoint_root(spark).removeprefix("file:"))
                if p.startswith("landed-same")]


def everything(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file()}


def test_a_run_that_dies_leaves_the_earlier_results(spark, feed, tmp_path, monkeypatch):
    config = RunConfig(feed, str(tmp_path / "out"), clustering=False, run_id="same")
    first = run(spark, config)
    root = tmp_path / "out/run-same"
    before = everything(root)
    monkeypatch.setattr("rolecall.plans.run.check_complete", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, config)
    after = everything(root)
    assert {k: v for k, v in after.items() if not k.startswith("_staging")} == before
    assert verify(spark, first.root).filter("finding <> 'ok'").count() == 0


@pytest.mark.parametrize("moved", [3])
def test_a_broken_exchange_is_finished_by_the_next_run(spark, feed, tmp_path, monkeypatch, moved):
    config = RunConfig(feed, str(tmp_path / "out"), clustering=False, run_id="same")
    run(spark, config)
    root, left, original = tmp_path / "out/run-same", [moved], Publisher._move
    stamp = (root / "manifests/run_manifest/_SUCCESS").stat().st_mtime_ns

    def move(self, path, stage):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt
        original(self, path, stage)

    monkeypatch.setattr(Publisher, "_move", move)
    with pytest.raises(KeyboardInterrupt):
        run(spark, config)
    assert not (root / "manifests/run_manifest").exists()  # nothing is taken for a result
    monkeypatch.setattr(Publisher, "_move", original)
    assert Publisher(spark, str(root)).recover(FEED)
    assert not Publisher(spark, str(root)).recover(FEED)
    assert (root / "manifests/run_manifest/_SUCCESS").stat().st_mtime_ns > stamp
    assert sorted(p.name for p in root.iterdir()) == ["manifests", "prepared", "queries", "tables", "validation"]
    assert verify(spark, str(root)).filter("finding <> 'ok'").count() == 0


def test_verification_names_what_was_altered_or_lost(spark, feed, tmp_path):
    form = "csv"
    result = run(spark, RunConfig(feed, str(tmp_path / "out"), clustering=False, format=form, file_digests=True))
    found = verify(spark, result.root).collect()
    assert {r.finding for r in found} == {"ok"}
    assert sum(r.file is None for r in found) == 25 and sum(r.file is not None for r in found) == 24
    prepared = tmp_path / result.root / "prepared/kev_prepared"
    parts = sorted(p for p in prepared.rglob("part-*") if p.is_file())
    gone = str(parts[0].relative_to(prepared))
    parts[0].unlink()
    path = f"{result.root}/tables/vendor_summary"
    changed = spark.read.format(form).options(header=True).load(path).limit(4).collect()
    rows = spark.createDataFrame(changed)
    rows.write.mode("overwrite").options(header=True).format(form).save(path)
    (tmp_path / result.root / "tables/ransomware_summary").rename(tmp_path / "away")
    bad = {(r.name, r.file): r.finding for r in verify(spark, result.root).collect() if r.finding != "ok"}
    assert bad[("kev_prepared", None)] == "lost" and bad[("kev_prepared", gone)] == "lost"
    assert bad[("vendor_summary", None)] == "altered" and bad[("ransomware_summary", None)] == "lost"
    assert {f for (n, _), f in bad.items() if n == "vendor_summary"} == {"altered", "lost", "unknown"}
    assert {n for n, _ in bad} == {"kev_prepared", "vendor_summary", "ransomware_summary"}


def test_data_core_has_a_manifest(spark, feed, tmp_path):
    result = run_data_core(spark, RunConfig(feed, str(tmp_path)))
    assert result.status == "data_core_complete"
    assert {r.name for r in result.manifest.collect()} == {
        "metadata", "validation_summary", "validation_details", "field_profile", "kev_prepared"}


@pytest.mark.parametrize("gone, outputs", [({"tags": None}, 22 - 6), ({"due": None}, 22 - 3)])
def test_roles_may_be_absent(spark, tmp_path, gone, outputs):
    """Without tags there are no tag tables and cases; without due days no window tables."""
    fields = tuple(f for f in FEED.raw_fields if f not in ("cwes" if "tags" in gone else "dueDate",))
    spec = FEED.with_options(fields=fields, **gone)
    table = spark.createDataFrame(catalog_rows(), RAW_SCHEMA).select(*fields)
    table.write.parquet(str(tmp_path / "in"))
    result = run(spark, RunConfig(str(tmp_path / "in"), str(tmp_path / "out"), spec=spec,
                                  clustering=False, input_kind="parquet"))
    assert result.status == "complete"
    assert {r.name for r in result.manifest.collect()} >= {
        n for n, t in registry(spec).items() if t.needs != "clustering" and n != "query_case"}
    assert len(required_outputs(spark, spec, False).collect()) == outputs


def test_an_output_gone_from_storage_is_missed(spark, feed, tmp_path):
    result = run(spark, RunConfig(feed, str(tmp_path), clustering=False))
    out = Publisher(spark, result.root)
    out.published = True
    check_complete(out, FEED, False)
    (tmp_path / result.root / "tables/vendor_summary/_SUCCESS").unlink()
    (tmp_path / result.root / "queries/query_case_2.csv/_SUCCESS").unlink()
    with pytest.raises(OutputMismatch) as err:
        check_complete(out, FEED, False)
    assert err.value.context["missing"] == ["queries/query_case_*.csv", "tables/vendor_summary"]


def test_csv_run(spark, feed, tmp_path):
    result = run(spark, RunConfig(feed, str(tmp_path), clustering=False, format="csv"))
    assert result.status == "complete" and result.manifest.count() == 25
    path = f"{result.root}/{registry(FEED)['vendor_summary'].path}"
    back = read_table_csv(
        spark, path, spark.createDataFrame(
            [], "vendor_clean string, record_count long, share double, cumulative_share double, "
            "product_count long").schema)
    assert back.agg(F.sum("record_count")).first()[0] == 90
    raw = spark.read.csv(path, header=True).first()
    assert len(raw.share.split(".")[1]) == 8
    prepared = spark.read.csv(f"{result.root}/prepared/kev_prepared", header=True, escape='"')
    row = prepared.filter("cveID = 'CVE-2024-1001'").first()
    assert json.loads(row.cwes) == list(catalog_rows()[1][-1]) and " " not in row.cwes
    assert row.dateAdded == catalog_rows()[1][4]


def test_parquet_input(spark, tmp_path):
    rows = spark.createDataFrame(catalog_rows(), RAW_SCHEMA)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    config = RunConfig(str(tmp_path / "in"), str(tmp_path / "out"), clustering=False,
                       input_kind="parquet")
    assert run(spark, config).status == "complete"


def test_stated_cases_may_be_empty(spark, feed, tmp_path):
    case = {"start_date": None, "end_date": None, "vendor": "nobody", "status": None, "tag": None}
    config = RunConfig(feed, str(tmp_path), clustering=False,
                       cases=tuple({"case_id": i, **case} for i in (1, 2, 3)))
    assert run(spark, config).status == "complete"


def test_writer_checks_columns_and_lists(spark, tmp_path):
    out = Publisher(spark, str(tmp_path / "p"))
    out.published = True  # no staging
    table = OutputTable("t", "tables/t", ("a", "b"), ("a DESC",))
    df = spark.createDataFrame([(1, 2, 3), (5, 6, 7)], "a int, b int, hidden int")
    out.write(df, table)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p/tables/t")).collect()] == [
        (5, 6), (1, 2)]
    assert out.records[0]["row_count"] == 2
    with pytest.raises(OutputMismatch):
        out.write(df.drop("b"), table)
    with pytest.raises(OutputMismatch):
        Publisher(spark, str(tmp_path), "xlsx")
    text = Publisher(spark, str(tmp_path / "c"), "csv")
    text.published = True
    one = spark.createDataFrame([("2026-07-29", ["CWE-79", "CWE-89"], 0.125)],
                                "d string, cwes array<string>, share double")
    one = one.withColumn("d", F.to_date("d"))
    text.write(one, OutputTable("x", "x", ("d", "cwes", "share"), ("d",)))
    line = spark.read.csv(str(tmp_path / "c/x"), header=True, escape='"').first()
    assert tuple(line) == ("2026-07-29", '["CWE-79","CWE-89"]', "0.12500000")


def test_missing_outputs(spark):
    required = required_outputs(spark, FEED, clustering=True)
    assert required.count() == 26
    assert required_outputs(spark, FEED, clustering=False).count() == 22
    stored = spark.createDataFrame(
        [(t.name, 2 if t.name == "query_case" else 1)
         for t in registry(FEED).values() if t.name != "vendor_summary"],
        "name string, parts int")
    got = {r.name for r in missing_outputs(required, stored).collect()}
    assert got == {"vendor_summary", "query_case"}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = prepared_frame(spark, catalog_rows())
    a = fingerprint(df).first()
    b = fingerprint(df.orderBy(F.desc("cveID")).repartition(5)).first()
    c = fingerprint(df.withColumn("notes", F.lit("x"))).first()
    assert a == b and a.fingerprint != c.fingerprint and a.row_count == 90


def test_source_digest(spark, feed):
    row = source_digest(spark, feed).first()
    assert len(row.sha256) == 64 and row.length > 0


def test_check_texts_are_complete():
    assert len(quality.CHECKS) == 12
