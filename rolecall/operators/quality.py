"""Data-quality checks that collect every problem and change nothing.

Row rules are one narrow pass: each row builds the array of rules it breaks and explodes it.
Only the repeated-id rule needs a shuffle, of the id and the row position alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.dates import day
from rolecall.functions.hotkeys import keep_members
from rolecall.functions.text import (
    full_match,
    has_edge_whitespace,
    is_blank,
    strip,
)
from rolecall.spec import BOOKKEEPING, MISTYPED, ROW_INDEX, CatalogSpec

# Check codes and severities; names and messages are display text.
FIELDS_CHECK = "KEV-SCHEMA-002"
REPEATED_ID = "KEV-VAL-003"
CHECKS = {
    "KEV-SCHEMA-002": ("FATAL", "field structure", "field names, number and order follow the contract"),
    "KEV-VAL-001": ("FATAL", "declared count", "the declared count equals the number of rows"),
    "KEV-VAL-002": ("FATAL", "expected row count", "the number of rows is the expected one"),
    "KEV-VAL-003": ("ERROR", "id present and unique", "the id is neither blank nor repeated"),
    "KEV-VAL-004": ("ERROR", "id format", "the id matches its pattern"),
    "KEV-VAL-005": ("ERROR", "date format", "dates are real days written YYYY-MM-DD"),
    "KEV-VAL-006": ("ERROR", "date order", "the due day does not precede the opening day"),
    "KEV-VAL-007": ("ERROR", "status domain", "the status is one of the allowed values"),
    "KEV-VAL-008": ("ERROR", "tag list type", "tags are a list"),
    "KEV-VAL-009": ("ERROR", "tag format", "every tag matches its pattern"),
    "KEV-VAL-010": ("ERROR", "key text present", "key text fields are not blank"),
    "KEV-VAL-011": ("FATAL", "expected counters", "tag and whitespace counters are the expected ones"),
}
SEVERITIES = ("FATAL", "ERROR", "WARNING", "INFO")
BLOCKING = ("FATAL", "ERROR")

SUMMARY_COLUMNS = ["check_id", "check_name", "severity", "passed", "actual", "expected", "message"]
PROFILE_COLUMNS = [
    "field", "dtype", "row_count", "non_null_count", "null_count", "empty_string_count",
    "unique_count",
]


@dataclass(frozen=True)
class QualityReport:
    summary: DataFrame
    issues: DataFrame
    profile: DataFrame

    def is_valid(self) -> bool:
        """No failed check that blocks. At most one row per check reaches the driver."""
        failed = self.summary.filter(~F.col("passed") & F.col("severity").isin(*BLOCKING))
        return failed.limit(1).count() == 0


def issue_columns(spec: CatalogSpec) -> list[str]:
    return ["issue_code", "severity", "row_index", spec.id, "field", "observed_value", "message"]


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BOOKKEEPING]


def display(df: DataFrame, name: str) -> Column:
    """A cell as text; lists as compact JSON, mistyped cells as the JSON they came in."""
    c = F.col(name)
    is_list = isinstance(df.schema[name].dataType, T.ArrayType)
    shown = F.to_json(c) if is_list else c.cast("string")
    if MISTYPED in df.columns:
        shown = F.coalesce(shown, F.col(MISTYPED)[name])
    return shown


def _was_mistyped(df: DataFrame, name: str) -> Column:
    if MISTYPED not in df.columns:
        return F.lit(False)
    return F.coalesce(F.map_contains_key(MISTYPED, F.lit(name)), F.lit(False))


def _blank_cell(df: DataFrame, name: str) -> Column:
    """Blank by value; a cell of another type is wrong elsewhere but not blank."""
    return is_blank(df, name) & ~_was_mistyped(df, name)


@dataclass(frozen=True)
class _Rule:
    code: str
    field: str
    broken: Column
    observed: Column


def _is_bad_tag(tag: Column, spec: CatalogSpec) -> Column:
    return tag.isNull() | ~full_match(tag, spec.tag_pattern)


def _any_broken(rules: list[_Rule]) -> Column:
    met = rules[0].broken
    for rule in rules[1:]:
        met = met | rule.broken
    return met


def row_rules(df: DataFrame, spec: CatalogSpec) -> list[_Rule]:
    """Rules decided by the row alone, one per (code, field)."""
    rules = [_Rule("KEV-VAL-003", spec.id, _blank_cell(df, spec.id), display(df, spec.id))]
    if spec.id_pattern:
        id_text = F.col(spec.id).cast("string")
        rules.append(
            _Rule("KEV-VAL-004", spec.id, ~full_match(id_text, spec.id_pattern), display(df, spec.id))
        )
    days = {name: day(df, name) for name in spec.date_fields}
    for name, value in days.items():
        rules.append(_Rule("KEV-VAL-005", name, value.isNull(), display(df, name)))
    if spec.due:
        reversed_ = F.coalesce(days[spec.due] < days[spec.opened], F.lit(False))
        rules.append(_Rule("KEV-VAL-006", spec.due, reversed_, display(df, spec.due)))
    allowed = F.coalesce(F.col(spec.status).isin(*spec.status_domain), F.lit(False))
    rules.append(_Rule("KEV-VAL-007", spec.status, ~allowed, display(df, spec.status)))
    if spec.tags:
        is_list = F.col(spec.tags).isNotNull()
        rules.append(_Rule("KEV-VAL-008", spec.tags, ~is_list, display(df, spec.tags)))
        if spec.tag_pattern:
            has_bad = F.exists(spec.tags, lambda t: _is_bad_tag(t, spec))
            bad = F.filter(spec.tags, lambda t: _is_bad_tag(t, spec))
            rules.append(
                _Rule("KEV-VAL-009", spec.tags, F.coalesce(has_bad, F.lit(False)), F.to_json(bad))
            )
    for name in spec.key_text:
        rules.append(_Rule("KEV-VAL-010", name, _blank_cell(df, name), display(df, name)))
    return rules


def id_groups(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """(id, n, blank): rows per id, counted before the shuffle."""
    return (
        df.groupBy(spec.id)
        .agg(F.count("*").alias("n"), F.count_if(_blank_cell(df, spec.id)).alias("blank"))
    )


def named_rows(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Rows with an id; blank ids have a rule of their own and are never grouped."""
    return df.filter(F.col(spec.id).isNotNull() & ~is_blank(df, spec.id))


def repeated_ids(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """(id, n) of ids that occur more than once."""
    return (
        named_rows(df, spec).groupBy(spec.id).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )


def _position(df: DataFrame) -> Column:
    has_index = ROW_INDEX in df.columns
    return (F.col(ROW_INDEX) if has_index else F.lit(None)).cast("bigint").alias("row_index")


def row_issues(df: DataFrame, spec: CatalogSpec, codes=None) -> DataFrame:
    """One row per broken rule and cell, from a single pass.

    A row that breaks nothing is dropped before any list is built. Null entries are dropped
    after the explode, so the rules stay in generated code.
    """
    rules = [r for r in row_rules(df, spec) if codes is None or r.code in codes]
    found = F.array(
        *[
            F.when(
                r.broken,
                F.struct(
                    F.lit(r.code).alias("issue_code"),
                    F.lit(r.field).alias("field"),
                    r.observed.alias("observed_value"),
                ),
            )
            for r in rules
        ]
    )
    broken = df.filter(_any_broken(rules))
    exploded = broken.select(_position(df), F.col(spec.id), F.explode(found).alias("i"))
    exploded = exploded.filter(F.col("i").isNotNull())
    return exploded.select("row_index", spec.id, "i.issue_code", "i.field", "i.observed_value")


def repeat_issues(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Every copy of a repeated id. Only id and position are moved; a hot id is matched in place."""
    slim = named_rows(df, spec).select(_position(df), F.col(spec.id))
    members = keep_members(slim, repeated_ids(df, spec), spec.id)
    return members.select(
        "row_index",
        spec.id,
        F.lit("KEV-VAL-003").alias("issue_code"),
        F.lit(spec.id).alias("field"),
        F.col(spec.id).cast("string").alias("observed_value"),
    )


def _lookup(code: Column, part: int) -> Column:
    pairs = [F.lit(v) for code_, info in CHECKS.items() for v in (code_, info[part])]
    return F.create_map(*pairs)[code]


def counters(df: DataFrame, spec: CatalogSpec) -> dict[str, Column]:
    """Aggregates of the expected-counters check, by name."""
    found = {}
    if spec.tags:
        size = F.size(spec.tags)
        tagged = F.coalesce(size > 0, F.lit(False))
        positive = F.coalesce(F.col(spec.status) == spec.positive_status, F.lit(False))
        other = F.coalesce(F.col(spec.status).isin(*spec.other_statuses), F.lit(False))
        found = {
            f"empty_{spec.tag_label}": F.count_if(size == 0),
            f"with_{spec.tag_label}": F.count_if(tagged),
            f"{spec.positive_key}_with_{spec.tag_label}": F.count_if(positive & tagged),
            f"{spec.other_key}_with_{spec.tag_label}": F.count_if(other & tagged),
        }
    found["vendor_whitespace"] = F.count_if(has_edge_whitespace(spec.vendor))
    found["product_whitespace"] = F.count_if(has_edge_whitespace(spec.product))
    return found


def _declared_count(metadata: DataFrame | None):
    return None if metadata is None else metadata.agg(F.sum("count")).scalar()


def check_summary(
    df: DataFrame, spec: CatalogSpec, metadata: DataFrame | None = None
) -> DataFrame:
    """One row per check, from one aggregate over the rows and one over the id counts."""
    fields = data_columns(df)
    fields_ok = tuple(fields) == spec.raw_fields
    aggregates = [F.count("*").alias("_rows")]
    # (code, actual text, expected text, passed) over the aggregated row
    rows = [
        (FIELDS_CHECK, F.lit(str(len(fields))), F.lit(str(len(spec.raw_fields))), F.lit(fields_ok))
    ]
    if metadata is not None:
        rows.append(
            ("KEV-VAL-001",
             F.to_json(F.struct(F.col("_declared").alias("metadata_count"),
                                F.col("_rows").alias("rows"))),
             F.lit("metadata_count = rows"),
             F.coalesce(F.col("_declared") == F.col("_rows"), F.lit(False)))
        )
    if spec.expected_rows is not None:
        rows.append(
            ("KEV-VAL-002", F.col("_rows").cast("string"), F.lit(str(spec.expected_rows)),
             F.col("_rows") == spec.expected_rows)
        )
    if fields_ok:
        per_code: dict[str, list] = {}
        for rule in row_rules(df, spec):
            per_code.setdefault(rule.code, []).append(rule.broken)
        for code, broken in per_code.items():
            if code == "KEV-VAL-003":
                continue
            if code == "KEV-VAL-010":  # counts cells
                count = sum((F.count_if(b) for b in broken[1:]), F.count_if(broken[0]))
            else:  # counts rows, also where several cells of a row are wrong
                any_broken = broken[0]
                for b in broken[1:]:
                    any_broken = any_broken | b
                count = F.count_if(any_broken)
            aggregates.append(count.alias(code))
        if spec.expected_counters is not None:
            found = counters(df, spec)
            aggregates.append(F.struct(*[c.alias(n) for n, c in found.items()]).alias("_counters"))
    one = df.agg(*aggregates)
    added = []
    if metadata is not None:
        added.append(_declared_count(metadata).alias("_declared"))
    if fields_ok:
        groups = id_groups(df, spec)
        repeated = F.col(spec.id).isNotNull() & (F.col("n") > 1)
        wrong_ids = groups.agg(
            F.coalesce(
                F.sum(F.when(repeated, F.col("n")).otherwise(F.col("blank"))), F.lit(0)
            ).alias("w")
        ).scalar()
        added.append(wrong_ids.alias("KEV-VAL-003"))
    one = one.select("*", *added)
    if fields_ok:
        for code in sorted({"KEV-VAL-003", *per_code}):
            expected = "0"
            if code == "KEV-VAL-007":
                expected = "[" + ",".join(f'"{s}"' for s in sorted(spec.status_domain)) + "]"
            n = F.col(f"`{code}`")
            rows.append((code, n.cast("string"), F.lit(expected), n == 0))
        if spec.expected_counters is not None:
            wanted = {n: int(spec.expected_counters[n]) for n in counters(df, spec)}
            same = F.lit(True)
            for name, value in wanted.items():
                same = same & (F.col(f"_counters.{name}") == value)
            text = "{" + ",".join(f'"{n}":{v}' for n, v in wanted.items()) + "}"
            rows.append(("KEV-VAL-011", F.to_json("_counters"), F.lit(text), same))
    cells = F.array(
        *[
            F.struct(
                F.lit(code).alias("check_id"),
                F.lit(CHECKS[code][1]).alias("check_name"),
                F.lit(CHECKS[code][0]).alias("severity"),
                passed.alias("passed"),
                actual.alias("actual"),
                expected.alias("expected"),
                F.lit(CHECKS[code][2]).alias("message"),
            )
            for code, actual, expected, passed in rows
        ]
    )
    return one.select(F.explode(cells).alias("c")).select("c.*").orderBy("check_id")


def table_issues(summary: DataFrame, spec: CatalogSpec, id_type: T.DataType) -> DataFrame:
    """A failed whole-table check is one issue without a row."""
    failed = summary.filter((F.col("severity") == "FATAL") & ~F.col("passed"))
    return failed.select(
        F.lit(None).cast("bigint").alias("row_index"),
        F.lit(None).cast(id_type).alias(spec.id),
        F.col("check_id").alias("issue_code"),
        F.lit(None).cast("string").alias("field"),
        F.col("actual").alias("observed_value"),
    )


def severity_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))


def issues(
    df: DataFrame, spec: CatalogSpec, summary: DataFrame | None = None, codes=None
) -> DataFrame:
    """Every issue with severity and message, in no particular order (see ``in_order``).

    ``codes`` names the checks known to fail. The others have no issues and are not looked
    for: clean input is not read again, and unique ids are not joined.
    """
    wanted = set(CHECKS) if codes is None else set(codes)
    id_type = df.schema[spec.id].dataType if spec.id in df.columns else T.StringType()
    parts = []
    if tuple(data_columns(df)) == spec.raw_fields:
        if wanted & {r.code for r in row_rules(df, spec)}:
            parts.append(row_issues(df, spec, wanted))
        if REPEATED_ID in wanted:
            parts.append(repeat_issues(df, spec))
    if summary is not None:
        parts.append(table_issues(summary, spec, id_type))
    if not parts:
        parts.append(_no_issues(df, spec, id_type))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.withColumn("severity", _lookup(F.col("issue_code"), 0)).withColumn(
        "message", _lookup(F.col("issue_code"), 2)
    )
    return found.select(*issue_columns(spec))


def _no_issues(df: DataFrame, spec: CatalogSpec, id_type: T.DataType) -> DataFrame:
    fields = [
        T.StructField("row_index", T.LongType()),
        T.StructField(spec.id, id_type),
        *[T.StructField(n, T.StringType()) for n in ("issue_code", "field", "observed_value")],
    ]
    return df.sparkSession.createDataFrame([], T.StructType(fields))


def in_order(found: DataFrame) -> DataFrame:
    """Most severe first, then by code, row and field; issues without a row come last."""
    return found.orderBy(
        severity_rank(), "issue_code", F.col("row_index").asc_nulls_last(), "field"
    )


def _profile_key(df: DataFrame, name: str) -> Column:
    """The cell's value as its digest, with a column of its own that says whether it is blank."""
    kind = df.schema[name].dataType
    text = F.to_json(name) if isinstance(kind, T.ArrayType) else F.col(name).cast("string")
    blank = strip(text) == "" if isinstance(kind, T.StringType) else F.lit(False)
    return F.struct(
        F.sha2(text, 256).alias("value"), F.coalesce(blank, F.lit(False)).alias("blank")
    ).alias(name)


def field_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls, whitespace-only strings and distinct values.

    Values are counted per (field, value) before they are counted per field, so a value that
    fills a third of a column is one partial row per task. Values travel as their digests.
    """
    names = data_columns(df)
    kinds = {n: df.schema[n].dataType for n in names}
    values = (
        df.select(*[_profile_key(df, n) for n in names])
        .unpivot([], names, "field", "cell")
        .groupBy("field", "cell.value", "cell.blank")
        .agg(F.count("*").alias("n"))
    )
    known = F.col("value").isNotNull()
    profile = values.groupBy("field").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("non_null_count"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("null_count"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("empty_string_count"),
        F.count("value").alias("unique_count"),
    )
    pairs = [F.lit(x) for n in names for x in (n, kinds[n].simpleString())]
    profile = profile.withColumn("dtype", F.create_map(*pairs)[F.col("field")])
    return profile.select(*PROFILE_COLUMNS).orderBy("field")  # one row per column


def validate(
    df: DataFrame, spec: CatalogSpec, metadata: DataFrame | None = None
) -> QualityReport:
    summary = check_summary(df, spec, metadata)
    return QualityReport(summary, in_order(issues(df, spec, summary)), field_profile(df))
