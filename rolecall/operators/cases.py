"""Query cases: three derived from the data, or any the caller states, run in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.errors import MissingColumns, RecordMismatch, require_columns
from rolecall.operators.search import Criteria, check_lists, conditions, summary_columns
from rolecall.operators.tags import long_table
from rolecall.session import cut_lineage
from rolecall.spec import VENDOR, YEAR, CatalogSpec

CASE_KEYS = ("case_id", "start_date", "end_date", "vendor", "status", "tag")
FEWEST_CASES = 3


@dataclass(frozen=True)
class CaseResult:
    """``rows`` carries ``case_id``; ``summary`` has one row per case, empty cases included."""

    summary: DataFrame
    rows: DataFrame
    cases: tuple[dict, ...]

    def rows_of(self, case_id: int, spec: CatalogSpec) -> DataFrame:
        mine = self.rows.filter(F.col("case_id") == case_id).drop("case_id")
        return mine.orderBy(F.desc(spec.opened), F.asc(spec.id))


def _ranked(rows: DataFrame, spec: CatalogSpec, first, second, unique: bool) -> DataFrame:
    """Candidates (first, second, distinct ids); the most frequent one leads, ties by name.

    Where an id cannot occur twice in a group, counting it is counting distinct ids.
    """
    ids = F.count(spec.id) if unique else F.count_distinct(spec.id)
    return (
        rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(first, second)
        .agg(ids.alias("record_count"))
        .orderBy(F.desc("record_count"), F.asc(first), F.asc(second))
    )


def year_vendor_candidates(df: DataFrame, spec: CatalogSpec, unique_ids: bool) -> DataFrame:
    """Year and vendor among positive records."""
    positive = df.filter(F.col(spec.status) == spec.positive_status)
    return _ranked(positive, spec, YEAR, VENDOR, unique_ids)


def vendor_tag_candidates(long: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Vendor and tag. The long table holds an (id, tag) once, so a group with a tag does too."""
    return _ranked(long, spec, VENDOR, spec.tag_label, unique=True)


def year_tag_candidates(long: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Year and tag among records of the second status of the domain."""
    rest = long.filter(F.col(spec.status) == spec.other_statuses[0])
    rest = rest.withColumn(YEAR, F.year(spec.opened).cast("bigint"))
    return _ranked(rest, spec, YEAR, spec.tag_label, unique=True)


def leaders(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """The leading candidates of a catalog whose ids are unique, in one scan.

    One row per record and distinct tag (one without a tag) is counted by three grouping sets, summed
    per task before the shuffle. A record counts by its first row alone where its tags do not matter.
    """
    tag = spec.tag_label
    rows = df.filter(F.col(spec.id).isNotNull()).select(
        YEAR, VENDOR, F.col(spec.status).alias("_status"),
        F.posexplode_outer(F.array_distinct(spec.tags)).alias("_place", tag),
    )
    is_tagged = F.col(tag).isNotNull()
    is_first = F.coalesce("_place", F.lit(0)) == 0
    counted = rows.groupingSets(
        [(YEAR, VENDOR), (VENDOR, tag), (YEAR, tag)], YEAR, VENDOR, tag
    ).agg(
        F.when(F.grouping(tag) == 1, 1).when(F.grouping(YEAR) == 1, 2).otherwise(3).alias("case_id"),
        F.count_if(is_first & (F.col("_status") == spec.positive_status)).alias("_records"),
        F.count_if(is_tagged).alias("_tagged"),
        F.count_if(is_tagged & (F.col("_status") == spec.other_statuses[0])).alias("_rest"),
    )
    case = F.col("case_id")
    count = F.when(case == 1, F.col("_records")).when(case == 2, F.col("_tagged"))
    named = (
        ((case == 2) | F.col(YEAR).isNotNull())
        & ((case == 3) | F.col(VENDOR).isNotNull())
        & ((case == 1) | F.col(tag).isNotNull())
    )
    counted = counted.withColumn("record_count", count.otherwise(F.col("_rest")))
    # The smallest struct is the largest count, then year, vendor and tag in order.
    lead = F.struct((-F.col("record_count")).alias("n"), YEAR, VENDOR, F.col(tag).alias("tag"))
    best = counted.filter(named & (F.col("record_count") > 0)).groupBy("case_id")
    return best.agg(F.min(lead).alias("b")).select(
        "case_id", F.col(f"b.{YEAR}").alias("year"), F.col(f"b.{VENDOR}").alias("vendor"),
        F.col("b.tag").alias("tag"), (-F.col("b.n")).alias("record_count"),
    )


def top_candidates(df: DataFrame, spec: CatalogSpec, unique_ids: bool = False) -> DataFrame:
    """The leading candidate of each of the three kinds, as one three-row table.

    Each kind is a branch of its own, as repeated ids need: distinct counts and the first row of each
    (id, tag). ``leaders`` gives the same for unique ids in one scan.
    """
    long = long_table(df, spec, unique_ids)
    picks = [
        year_vendor_candidates(df, spec, unique_ids).limit(1).select(
            F.lit(1).alias("case_id"), F.col(YEAR).alias("year"), F.col(VENDOR).alias("vendor"),
            F.lit(None).cast("string").alias("tag"), "record_count",
        ),
        vendor_tag_candidates(long, spec).limit(1).select(
            F.lit(2), F.lit(None).cast("bigint"), F.col(VENDOR), F.col(spec.tag_label),
            "record_count",
        ),
        year_tag_candidates(long, spec).limit(1).select(
            F.lit(3), F.col(YEAR), F.lit(None).cast("string"), F.col(spec.tag_label),
            "record_count",
        ),
    ]
    return picks[0].union(picks[1]).union(picks[2])


def default_cases(df: DataFrame, spec: CatalogSpec, unique_ids: bool = False) -> tuple[dict, ...]:
    """Three reproducible, non-empty cases. Three rows reach the driver, nothing else."""
    require_columns(df, spec.prepared_fields, MissingColumns, "case input")
    best = leaders(df, spec) if unique_ids else top_candidates(df, spec)
    found = {r.case_id: r for r in best.collect()}
    if 1 not in found:
        if df.isEmpty():
            raise RecordMismatch("no records to derive cases from")
        raise RecordMismatch(f"no record has status {spec.positive_status}")
    if 2 not in found:
        raise RecordMismatch("no record has a tag")
    if 3 not in found:
        raise RecordMismatch(f"no tagged record has status {spec.other_statuses[0]}")

    def case(case_id, year, vendor, status, tag):
        return {
            "case_id": case_id,
            "start_date": f"{year:04d}-01-01" if year is not None else None,
            "end_date": f"{year:04d}-12-31" if year is not None else None,
            "vendor": vendor,
            "status": status,
            "tag": tag,
        }

    return (
        case(1, found[1].year, found[1].vendor, spec.positive_status, None),
        case(2, None, found[2].vendor, None, found[2].tag),
        case(3, found[3].year, None, spec.other_statuses[0], found[3].tag),
    )


def normalize_cases(cases: Sequence[Mapping], spec: CatalogSpec) -> tuple[dict, ...]:
    """Check keys and ids; every other value becomes text or stays None.

    Status and tag may go by the catalog's own labels, as they do in the summary.
    """
    labels = {spec.status_label: "status", spec.tag_label: "tag"}
    ready = []
    for given in cases:
        case = {labels.get(k, k): v for k, v in given.items()}
        missing = sorted(set(CASE_KEYS) - set(case))
        if missing:
            raise ValueError(f"case lacks {missing}")
        text = {k: None if case[k] is None else str(case[k]) for k in CASE_KEYS[1:]}
        ready.append({"case_id": int(case["case_id"]), **text})
    ids = [c["case_id"] for c in ready]
    if any(i <= 0 for i in ids):
        raise ValueError("case_id must be positive")
    if len(set(ids)) != len(ids):
        raise ValueError("case_id must be unique")
    if len(ready) < FEWEST_CASES:
        raise ValueError(f"at least {FEWEST_CASES} cases are needed")
    return tuple(ready)


def run_cases(
    df: DataFrame,
    spec: CatalogSpec,
    cases: Sequence[Mapping] | None = None,
    unique_ids: bool = False,
    checked: bool = False,
    store: bool = False,
) -> CaseResult:
    """All cases in one scan: each row is marked with the cases it meets, then exploded.

    ``store`` keeps the matching rows, so the summary and the rows share that one scan.

    A case's vendor is picked by its exact name and searched as a substring, like any search.
    """
    require_columns(df, spec.prepared_fields, MissingColumns, "case input")
    ready = normalize_cases(
        cases if cases is not None else default_cases(df, spec, unique_ids), spec
    )
    wanted = {
        c["case_id"]: conditions(Criteria(**{k: c[k] for k in CASE_KEYS[1:]}), spec) for c in ready
    }
    if not checked and any(w.tag for w in wanted.values()):
        check_lists(df, spec)
    met = {i: w.column(spec, df.columns) for i, w in wanted.items()}
    any_met = F.lit(False)
    for column in met.values():
        any_met = any_met | column
    ids = F.array(*[F.when(column, F.lit(i)) for i, column in met.items()])
    # The OR goes ahead of the explode, so day ranges still reach the scan.
    rows = df.filter(any_met).withColumn("case_id", F.explode(ids))
    rows = rows.filter(F.col("case_id").isNotNull())
    if store:
        rows = cut_lineage(rows)
    counted = rows.groupBy("case_id").agg(*summary_columns(spec))
    schema = "case_id int, " + ", ".join(f"{k} string" for k in CASE_KEYS[1:])
    stated = df.sparkSession.createDataFrame(
        [tuple(c[k] for k in CASE_KEYS) for c in ready], schema
    )
    positive = f"{spec.positive_key}_count"
    zero = F.lit(0).cast("bigint")
    summary = stated.join(counted, "case_id", "left").select(
        *CASE_KEYS[:4],
        F.col("status").alias(spec.status_label),
        F.col("tag").alias(spec.tag_label),
        F.coalesce("record_count", zero).alias("record_count"),
        F.coalesce("vendor_count", zero).alias("vendor_count"),
        F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
        F.coalesce(positive, zero).alias(positive),
        F.concat(F.lit("query_case_"), F.col("case_id"), F.lit(".csv")).alias("output_file"),
    )
    return CaseResult(summary.orderBy("case_id"), rows, ready)
