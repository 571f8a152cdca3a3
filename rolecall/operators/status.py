"""Status totals and the status-by-year table over a closed status domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.errors import StatisticsInput, require_columns
from rolecall.functions.guards import offenders
from rolecall.spec import YEAR, CatalogSpec, slug


@dataclass(frozen=True)
class StatusResult:
    totals: DataFrame
    by_year: DataFrame


def status_counts(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """(added_year, status, n): one row per year and status."""
    return df.groupBy(YEAR, F.col(spec.status).alias("status")).agg(F.count("*").alias("n"))


def _count_of(status: str):
    return F.sum(F.when(F.col("status") == status, F.col("n")).otherwise(0))


def totals(counts: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Every status of the domain in its order, absent ones with zero."""
    row = counts.agg(
        F.sum("n").alias("_total"),
        *[_count_of(s).alias(f"_n{i}") for i, s in enumerate(spec.status_domain)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(s).alias("status"),
                F.coalesce(f"_n{i}", F.lit(0)).alias("record_count"),
                F.lit(i + 1).cast("bigint").alias("status_order"),
            )
            for i, s in enumerate(spec.status_domain)
        ]
    )
    return row.select("_total", F.explode(cells).alias("c")).select(
        "c.status",
        "c.record_count",
        (F.col("c.record_count") / F.col("_total")).alias("share"),
        "c.status_order",
    )


def by_year(counts: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Per year: a count per status, the total, and a share per status."""
    keys = [slug(s) for s in spec.status_domain]
    inside = counts.filter(F.col("status").isin(*spec.status_domain))
    table = inside.groupBy(YEAR).agg(
        *[
            _count_of(s).alias(f"{k}_count")
            for s, k in zip(spec.status_domain, keys, strict=True)
        ],
        F.sum("n").alias("total_count"),
    )
    return table.select(
        YEAR,
        *[f"{k}_count" for k in keys],
        "total_count",
        *[(F.col(f"{k}_count") / F.col("total_count")).alias(f"{k}_share") for k in keys],
    )


def unsupported_statuses(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Observed values outside the domain."""
    return (
        df.select(F.col(spec.status).alias("status"))
        .filter(~F.col("status").isin(*spec.status_domain))
        .distinct()
    )


def check_counts(counts: DataFrame, spec: CatalogSpec) -> None:
    row = counts.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("status").isNull() | F.col(YEAR).isNull()).alias("missing"),
    ).first()
    if row.groups == 0:
        raise StatisticsInput("status statistics need at least one record")
    if row.missing:
        raise StatisticsInput(f"status and {YEAR} must not be missing")
    outside = counts.filter(~F.col("status").isin(*spec.status_domain)).select("status").distinct()
    bad, all_of_them = offenders(outside, "status")
    if bad:
        shown = sorted(r.status for r in bad)
        raise StatisticsInput(f"unsupported status values: {shown} {all_of_them}")


def analyze(df: DataFrame, spec: CatalogSpec, check: bool = True) -> StatusResult:
    require_columns(df, [spec.status, YEAR], StatisticsInput, "status input")
    counts = status_counts(df, spec)
    if check:
        counts = counts.persist()
        check_counts(counts, spec)
    return StatusResult(totals(counts, spec), by_year(counts, spec))
