"""Strict reading of envelope documents: one JSON object that carries an array of records.

Documents are read as VARIANT, so every field name and every actual type is still there to
be checked. A multi-line document is parsed by one task; many documents, or one document
per line, are parsed in parallel. Either way ``land`` writes the records once as Parquet and
everything after that reads Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.errors import (
    EnvelopeMismatch,
    RecordMismatch,
    SourceEncoding,
    SourceMalformed,
    SourceNotFound,
)
from rolecall.functions.guards import offenders
from rolecall.session import cut_lineage
from rolecall.spec import MISTYPED, ROW_INDEX, SOURCE, VULNERABILITY_FEED, CatalogSpec

# The envelope's own fields and the type each must have.
ENVELOPE_TYPES = {
    "title": "STRING",
    "catalogVersion": "STRING",
    "dateReleased": "STRING",
    "count": "BIGINT",
    "vulnerabilities": "ARRAY",
}
RECORDS_FIELD = "vulnerabilities"


@dataclass(frozen=True)
class Envelope:
    """``metadata``: one row per document. ``records``: typed rows in contract order."""

    metadata: DataFrame
    records: DataFrame


def read_documents(spark: SparkSession, path, one_per_line: bool = False) -> DataFrame:
    """(source_file, doc VARIANT) of a file, folder or glob. ``doc`` is null where malformed."""
    reader = spark.read.option("multiLine", not one_per_line).option("singleVariantColumn", "doc")
    try:
        docs = reader.json(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise SourceNotFound("no such input", path=str(path)) from err
        raise
    return docs.select(F.col("_metadata.file_path").alias(SOURCE), "doc")


def _type_of(c):
    return F.schema_of_variant(c)


def _problems() -> Column:
    """The broken envelope rules of ``doc`` as a list; null when none.

    Only the top level is opened; the types inside the record array are not looked at here.
    """
    top = F.try_variant_get("doc", "$", "map<string,variant>")
    rules = [
        (F.col("doc").isNull(), "not JSON"),
        (F.col("doc").isNotNull() & top.isNull(), "not an object"),
    ]
    for name, wanted in ENVELOPE_TYPES.items():
        if wanted == "ARRAY":
            is_wanted = F.try_variant_get("doc", f"$.{name}", "array<variant>").isNotNull()
        else:
            is_wanted = _type_of(F.try_variant_get("doc", f"$.{name}", "variant")) == wanted
        has_field = F.map_contains_key(top, name)
        rules.append((~has_field, f"{name} is missing"))
        rules.append((has_field & ~is_wanted, f"{name} is not {wanted}"))
    problems = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    return F.when(_any(r[0] for r in rules), problems)


def envelope_problems(docs: DataFrame) -> DataFrame:
    """(source_file, problems): per document the list of broken envelope rules; null when none."""
    return docs.select(SOURCE, _problems().alias("problems"))


def _any(conditions):
    """One boolean in generated code; lists of findings are built only where it holds."""
    met = F.lit(False)
    for condition in conditions:
        met = met | F.coalesce(condition, F.lit(False))
    return met


def flatten_records(docs: DataFrame) -> DataFrame:
    """(source_file, row_index, rec VARIANT): one row per record, position kept."""
    records = F.variant_get("doc", f"$.{RECORDS_FIELD}", "array<variant>")
    return docs.select(SOURCE, F.posexplode(records).alias(ROW_INDEX, "rec"))


def _field_findings(spec: CatalogSpec) -> list[Column]:
    names = F.map_keys(F.try_variant_get("rec", "$", "map<string,variant>"))
    wanted = F.array(*[F.lit(f) for f in spec.raw_fields])
    return [
        names.isNull().alias("not_an_object"),
        F.array_except(wanted, names).alias("missing"),
        F.array_except(names, wanted).alias("extra"),
    ]


FINDINGS = ("not_an_object", "missing", "extra")
HAS_FINDING = "not_an_object OR size(missing) > 0 OR size(extra) > 0"


def record_problems(flat: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Records that are not objects or whose field set differs from the closed contract."""
    return flat.select(SOURCE, ROW_INDEX, *_field_findings(spec)).filter(HAS_FINDING)


def typed_records(flat: DataFrame, spec: CatalogSpec, findings: bool = False) -> DataFrame:
    """Contract columns in contract order, then ``row_index``, ``mistyped`` and ``source_file``.

    A cell of the wrong type becomes null and its JSON text is kept in the map ``mistyped``,
    which is null for the usual row without any. ``findings`` adds the field check's result, so
    that one parse yields both.
    """
    columns, wrong = [], []
    for name in spec.raw_fields:
        cell = F.try_variant_get("rec", f"$.{name}", "variant")
        kind = _type_of(cell)
        if name == spec.tags:
            is_good = kind.startswith("ARRAY")
            members = F.try_variant_get("rec", f"$.{name}", "array<variant>")
            value = F.transform(
                members,
                lambda m: F.coalesce(F.try_variant_get(m, "$", "string"), F.to_json(m)),
            )
        else:
            is_good = kind == "STRING"
            value = F.try_variant_get("rec", f"$.{name}", "string")
        columns.append(F.when(is_good, value).alias(name))
        is_wrong = ~is_good & (kind != "VOID")
        wrong.append((is_wrong, F.struct(F.lit(name), F.to_json(cell))))
    entries = F.array_compact(F.array(*[F.when(bad, entry) for bad, entry in wrong]))
    mistyped = F.when(_any(w[0] for w in wrong), F.map_from_entries(entries))
    checked = _field_findings(spec) if findings else []
    names = [f.alias(f"_found_{i}") for i, f in enumerate(checked)]
    cells = flat.select(F.struct(*columns, mistyped.alias(MISTYPED)).alias("_cells"), SOURCE, ROW_INDEX, *names)
    # The explode of one row keeps later filters and columns from opening the record again.
    once = cells.select(F.explode(F.array("_cells")).alias("_row"), SOURCE, ROW_INDEX, *cells.columns[3:])
    return once.select(
        *[F.col("_row")[name].alias(name) for name in spec.raw_fields],
        F.col(ROW_INDEX).cast("bigint").alias(ROW_INDEX),
        F.col("_row")[MISTYPED].alias(MISTYPED),
        SOURCE,
        *[F.col(f"_found_{i}").alias(name) for i, name in enumerate(FINDINGS[:len(checked)])],
    )


def _metadata_columns(spec: CatalogSpec) -> list[Column]:
    text = [
        F.try_variant_get("doc", f"$.{n}", "string").alias(n)
        for n in ("title", "catalogVersion", "dateReleased")
    ]
    size = F.size(F.try_variant_get("doc", f"$.{RECORDS_FIELD}", "array<variant>"))
    return [
        F.col(SOURCE),
        *text,
        F.try_variant_get("doc", "$.count", "bigint").alias("count"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("actualRecordCount"),
        F.array(*[F.lit(f) for f in spec.raw_fields]).alias("originalFields"),
    ]


def metadata(docs: DataFrame, spec: CatalogSpec) -> DataFrame:
    """One row per document: its own statements, the actual row count and the field list."""
    return docs.select(*_metadata_columns(spec))


def check_encoding(spark: SparkSession, path) -> None:
    files = spark.read.format("binaryFile").load(path)
    bad = files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path")
    broken, all_of_them = offenders(bad, "encoding")
    if broken:
        raise SourceEncoding("input is not UTF-8", path=[r.path for r in broken], **all_of_them)


def check_line_encoding(spark: SparkSession, path) -> None:
    """Refuse line files that hold broken UTF-8. Only input that does not parse is read again."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    bad = lines.filter(~F.is_valid_utf8("value")).select("path").distinct()
    broken, all_of_them = offenders(bad, "encoding")
    if broken:
        raise SourceEncoding("input is not UTF-8", path=[r.path for r in broken], **all_of_them)


def check_envelopes(described: DataFrame) -> None:
    """Refuse documents with ``problems``; input that is not JSON anywhere outweighs the rest."""
    bad = described.filter("problems IS NOT NULL").select(SOURCE, "problems")
    broken, all_of_them = offenders(bad.filter(F.array_contains("problems", "not JSON")), "json")
    if broken:
        raise SourceMalformed(
            "input is not valid JSON", path=[r[SOURCE] for r in broken], **all_of_them
        )
    shown, all_of_them = offenders(bad, "envelope")
    if shown:
        raise EnvelopeMismatch(
            "envelope fields differ from the contract",
            problems=[(r[SOURCE], list(r.problems)) for r in shown], **all_of_them,
        )


def check_records(findings: DataFrame) -> None:
    """Refuse records with findings, naming the first few and the table of all."""
    bad = findings.filter(HAS_FINDING).select(ROW_INDEX, "missing", "extra")
    shown, all_of_them = offenders(bad, "records")
    if shown:
        raise RecordMismatch(
            "record fields differ from the contract",
            records=[(r[ROW_INDEX], list(r.missing or []), list(r.extra or [])) for r in shown],
            **all_of_them,
        )


def checked_records(
    flat: DataFrame, spec: CatalogSpec, landing: str | None, rebalance: bool
) -> DataFrame:
    """Typed records after the field check. With ``landing`` they are parsed and stored once and
    the check reads the stored findings; without it the check is a pass of its own."""
    typed = typed_records(flat, spec, findings=True)
    if landing is not None:
        typed = land(typed, landing, rebalance)
    check_records(typed)
    return typed.drop(*FINDINGS)


def read_envelope(
    spark: SparkSession,
    path,
    spec: CatalogSpec = VULNERABILITY_FEED,
    one_per_line: bool = False,
    landing: str | None = None,
) -> Envelope:
    """Read envelope documents and reject broken ones; no business cleaning.

    ``landing`` names a shared folder for the records: then the input is parsed twice, once
    for the one-row-per-document description and once for the records, however often the
    result is used.
    """
    docs = read_documents(spark, path, one_per_line)
    if not one_per_line:
        # A whole document is one binary row anyway; line files are checked by the parser.
        check_encoding(spark, path)
    described = cut_lineage(
        docs.select(*_metadata_columns(spec), _problems().alias("problems"))
    )
    if not one_per_line and described.count() < len(docs.inputFiles()):
        raise SourceMalformed("a file holds no document", path=str(path))
    if one_per_line and not described.filter(F.array_contains("problems", "not JSON")).isEmpty():
        check_line_encoding(spark, path)
    check_envelopes(described)
    records = checked_records(flatten_records(docs), spec, landing, not one_per_line)
    return Envelope(described.drop("problems"), records)


def land(records: DataFrame, path: str, rebalance: bool = True) -> DataFrame:
    """Write the records once as Parquet and return the written table.

    ``rebalance`` spreads them over evenly sized files, which whole documents need because one
    task holds all of a document's records. Line input is spread already.
    """
    spread = records.hint("rebalance") if rebalance else records
    spread.write.mode("overwrite").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path)
