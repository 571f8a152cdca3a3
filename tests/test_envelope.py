import json

import pytest
from pyspark.sql import functions as F

from rolecall.errors import (
    EnvelopeMismatch,
    RecordMismatch,
    SourceEncoding,
    SourceMalformed,
    SourceNotFound,
)
from rolecall.sources import envelope, records, star
from rolecall.spec import VULNERABILITY_FEED as FEED
from tests.frames import RAW_SCHEMA, FEW_ROWS


def as_records(rows):
    return [dict(zip(FEED.raw_fields, r, strict=True)) for r in rows]


def document(rows, **changes):
    doc = {
        "title": "Catalog", "catalogVersion": "2024.03.10", "dateReleased": "2024-03-10T00:00:00Z",
        "count": len(rows), "vulnerabilities": rows,
    }
    doc.update(changes)
    return {k: v for k, v in doc.items() if v != "drop"}


def write(tmp_path, payload, name="feed.json"):
    path = tmp_path / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload, indent=2),
                    encoding="utf-8")
    return str(path)


def test_reads_records_in_contract_order(spark, tmp_path):
    rows = as_records(FEW_ROWS)
    shuffled = [dict(reversed(r.items())) for r in rows]
    path = write(tmp_path, document(shuffled, extra_top=1))
    read = envelope.read_envelope(spark, path)
    assert tuple(read.records.columns[:11]) == FEED.raw_fields
    got = read.records.orderBy("row_index").collect()
    assert [tuple(r[:11]) for r in got] == [tuple(r) for r in FEW_ROWS]
    assert [r.row_index for r in got] == [0, 1, 2]
    meta = read.metadata.first()
    assert (meta.title, meta["count"], meta.actualRecordCount) == ("Catalog", 3, 3)
    assert tuple(meta.originalFields) == FEED.raw_fields


def test_empty_array_keeps_columns(spark, tmp_path):
    read = envelope.read_envelope(spark, write(tmp_path, document([])))
    assert read.records.count() == 0
    assert tuple(read.records.columns[:11]) == FEED.raw_fields
    assert read.metadata.first().actualRecordCount == 0


def test_missing_file(spark, tmp_path):
    with pytest.raises(SourceNotFound) as err:
        envelope.read_envelope(spark, str(tmp_path / "nope.json"))
    assert err.value.code == "KEV-IO-001"


def test_broken_json(spark, tmp_path):
    with pytest.raises(SourceMalformed) as err:
        envelope.read_envelope(spark, write(tmp_path, "{broken"))
    assert err.value.code == "KEV-IO-002"


def test_empty_file_beside_a_good_one(spark, tmp_path):
    write(tmp_path, document([]), "a.json")
    write(tmp_path, "", "b.json")
    with pytest.raises(SourceMalformed):
        envelope.read_envelope(spark, str(tmp_path))
    with pytest.raises(SourceMalformed):
        envelope.read_envelope(spark, str(tmp_path / "b.json"))


def test_not_utf8(spark, tmp_path):
    path = tmp_path / "latin.json"
    path.write_bytes(json.dumps(document([], title="é"), ensure_ascii=False).encode("latin-1"))
    with pytest.raises(SourceEncoding) as err:
        envelope.read_envelope(spark, str(path))
    assert err.value.code == "KEV-IO-003"


@pytest.mark.parametrize(
    "payload",
    [
        {"title": "only"},
        5,
        document([], vulnerabilities=None),
        [],
        document([], count=True),
        document([], count="0"),
        document([], count=1.5),
        document([], title=5),
        document([], catalogVersion=None),
        document([], dateReleased=["x"]),
        document([], vulnerabilities={}),
        document([], count="drop"),
    ],
)
def test_bad_envelope(spark, tmp_path, payload):
    with pytest.raises(EnvelopeMismatch) as err:
        envelope.read_envelope(spark, write(tmp_path, payload))
    assert err.value.code == "KEV-SCHEMA-001"


def test_record_fields_are_closed(spark, tmp_path):
    rows = as_records(FEW_ROWS)
    rows[1] = {k: v for k, v in rows[1].items() if k != "product"} | {"severity": "high"}
    with pytest.raises(RecordMismatch) as err:
        envelope.read_envelope(spark, write(tmp_path, document(rows)))
    assert err.value.code == "KEV-SCHEMA-002"
    assert err.value.context["records"] == [(1, ["product"], ["severity"])]


def test_the_error_class_follows_from_all_documents(spark, tmp_path):
    """One document that is not JSON outweighs any number with a missing field."""
    folder = tmp_path / "many"
    folder.mkdir()
    lacking = {k: v for k, v in document([]).items() if k != "title"}
    for i in range(30):
        write(folder, lacking, f"{i:02}.json")
    with pytest.raises(EnvelopeMismatch) as err:
        envelope.read_envelope(spark, str(folder))
    assert err.value.context["count"] == 30 and len(err.value.context["problems"]) == 20
    assert spark.read.parquet(err.value.context["stored"]).count() == 30
    write(folder, "{broken", "zz.json")
    with pytest.raises(SourceMalformed):
        envelope.read_envelope(spark, str(folder))


def test_record_must_be_an_object(spark, tmp_path):
    with pytest.raises(RecordMismatch):
        envelope.read_envelope(spark, write(tmp_path, document([5])))


def test_mistyped_cells_are_kept_aside(spark, tmp_path):
    rows = as_records(FEW_ROWS)
    rows[0]["cwes"] = "CWE-79"
    rows[1]["vendorProject"] = 7
    rows[2]["cwes"] = ["CWE-1", 79, None]
    read = envelope.read_envelope(spark, write(tmp_path, document(rows)))
    got = read.records.orderBy("row_index").collect()
    assert got[0].cwes is None and got[0].mistyped == {"cwes": '"CWE-79"'}
    assert got[1].vendorProject is None and got[1].mistyped == {"vendorProject": "7"}
    assert got[2].cwes[:2] == ["CWE-1", "79"] and len(got[2].cwes) == 3


def test_many_documents_and_lines(spark, tmp_path):
    rows = as_records(FEW_ROWS)
    folder = tmp_path / "docs"
    folder.mkdir()
    for i, r in enumerate(rows):
        write(folder, document([r]), f"{i}.json")
    read = envelope.read_envelope(spark, str(folder))
    assert read.records.count() == 3 and read.metadata.count() == 3
    lines = write(tmp_path, "\n".join(json.dumps(document([r])) for r in rows), "all.jsonl")
    by_line = envelope.read_envelope(spark, lines, one_per_line=True)
    assert sorted(r.cveID for r in by_line.records.collect()) == sorted(r[0] for r in FEW_ROWS)
    plain = write(tmp_path, "\n".join(json.dumps(r) for r in rows), "records.jsonl")
    direct = records.read_record_lines(spark, plain)
    assert sorted(r.cveID for r in direct.collect()) == sorted(r[0] for r in FEW_ROWS)
    broken = write(tmp_path, json.dumps(rows[0]) + "\n{oops", "bad.jsonl")
    with pytest.raises(RecordMismatch):
        records.read_record_lines(spark, broken)


def test_land_and_parquet_index(spark, tmp_path):
    read = envelope.read_envelope(spark, write(tmp_path, document(as_records(FEW_ROWS))))
    stored = envelope.land(read.records, str(tmp_path / "landed"))
    assert sorted(stored.collect()) == sorted(read.records.collect())
    many = spark.createDataFrame(FEW_ROWS * 5, RAW_SCHEMA)
    many.repartition(4).write.parquet(str(tmp_path / "records"))
    back = records.read_record_parquet(spark, str(tmp_path / "records"))
    assert sorted(r.row_index for r in back.collect()) == list(range(15))
    again = records.read_record_parquet(spark, str(tmp_path / "records"))
    assert sorted(back.select("row_index", "cveID").collect()) == sorted(
        again.select("row_index", "cveID").collect()
    )


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_columns_of_typed_records_do_not_open_them_again(spark):
    docs = spark.range(3).selectExpr(
        "'f' AS source_file",
        """explode(array(parse_json('{"vulnerabilities":[{"l_orderkey":"1","flags":["A",2],"l_suppkey":7}]}'))) AS doc""",
    )
    typed = envelope.typed_records(envelope.flatten_records(docs), star.LINE_RECORDS, findings=True)
    row = typed.first()
    assert (row.l_orderkey, row.flags, row.l_suppkey, row.mistyped) == ("1", ["A", "2"], None, {"l_suppkey": "7"})
    assert sorted(row.missing) == ["l_partkey", "l_returnflag", "l_shipdate"] and row.extra == []
    typed = typed.drop(*envelope.FINDINGS)
    sorted_ = F.array_join(F.array_sort(F.map_keys("mistyped")), ",")
    used = typed.filter("flags IS NOT NULL AND l_suppkey IS NULL").withColumn("mistyped", sorted_)
    assert [r.mistyped for r in used.collect()] == ["l_suppkey"] * 3
    assert _optimized(used).count("variant_get") == _optimized(typed).count("variant_get")


def test_line_envelopes_write_odd_texts_and_leave_nulls_out(spark, tmp_path):
    rows = [
        (1, 10, 20, 1, 9.0, 5.0, 0.1, 0.1, 'a"\\\n', "é", "1996-01-02 00:00:00"),
        (1, None, None, 2, None, None, None, None, None, "F", None),
        (1, 11, 21, 7, 2.0, 5.0, 0.0, 0.0, "R", "F", "1996-01-03 00:00:00"),
    ]
    schema = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    )
    df = spark.createDataFrame(rows, schema).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    docs = star.line_envelopes(spark, str(tmp_path))
    flat = envelope.flatten_records(docs).select("row_index", F.to_json("rec").alias("rec"))
    got = [json.loads(r.rec) for r in flat.orderBy("row_index").collect()]
    assert got == [
        {"l_orderkey": "1", "l_suppkey": "20", "l_partkey": "10", "l_shipdate": "1996-01-02", "l_returnflag": 'a"\\\n',
         "flags": ['a"\\\n', "é"]},
        {"l_orderkey": "1", "flags": [None, "F"]},
        {"l_orderkey": "1", "l_suppkey": 21, "l_shipdate": "1996-01-03", "l_returnflag": "R", "flags": "R",
         "l_comment": "full price"},
    ]
    # An aggregate's own argument would be interpreted, row by row.
    assert "collect_list(line#" in _optimized(docs)
