"""Monthly, yearly and same-period counts on a gap-free month spine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.errors import StatisticsInput, require_columns
from rolecall.functions.dates import month_label
from rolecall.functions.guards import offenders
from rolecall.spec import MONTH, YEAR, CatalogSpec


@dataclass(frozen=True)
class Timeline:
    monthly: DataFrame
    annual: DataFrame
    same_period: DataFrame


def observed_months(df: DataFrame, opened: str) -> DataFrame:
    """(added_month, record_count) for the months that occur; null days stay as a null month."""
    return df.groupBy(month_label(F.col(opened)).alias(MONTH)).agg(
        F.count("*").alias("record_count")
    )


def _first_day(label) -> Column:
    return F.to_date(F.concat(label, F.lit("-01")), "yyyy-MM-dd")


def monthly_counts(
    observed: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Counts for every month from ``start`` to ``end``, zeros included.

    The default is from the first to the last month seen. A month table has at most twelve
    rows a year, so the spine and its join stay small.
    """
    observed = observed.filter(F.col(MONTH).isNotNull())
    bounds = observed.agg(
        F.coalesce(F.lit(start), F.min(MONTH)).alias("first"),
        F.coalesce(F.lit(end), F.max(MONTH)).alias("last"),
        F.sum("record_count").alias("total"),
    ).filter("total > 0" if start is None or end is None else "true")
    months = F.sequence(_first_day("first"), _first_day("last"), F.expr("interval 1 month"))
    spine = bounds.select(F.explode(months).alias("_day")).select(
        month_label(F.col("_day")).alias(MONTH)
    )
    return spine.join(observed, MONTH, "left").select(
        MONTH, F.coalesce("record_count", F.lit(0).cast("bigint")).alias("record_count")
    )


def _with_parts(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        F.substring(MONTH, 1, 4).cast("bigint").alias(YEAR),
        F.substring(MONTH, 6, 2).cast("bigint").alias("month"),
        "record_count",
    )


def annual_summary(monthly: DataFrame, incomplete_years=frozenset()) -> DataFrame:
    """Per year over the spine: a covered month without records still counts as covered."""
    yearly = (
        _with_parts(monthly)
        .groupBy(YEAR)
        .agg(
            F.sum("record_count").alias("record_count"),
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
            F.count("*").alias("covered_months"),
        )
    )
    whole = F.col("covered_months") == 12
    return yearly.withColumn("is_complete_year", whole & ~F.col(YEAR).isin(*incomplete_years))


def same_period(monthly: DataFrame, months: tuple[int, int] = (1, 7)) -> DataFrame:
    """Counts of the same months of each year, from the year after the first one on."""
    parts = _with_parts(monthly)
    first_year = parts.agg(F.min(YEAR)).scalar()
    return (
        parts.filter(F.col("month").between(*months) & (F.col(YEAR) >= first_year + 1))
        .groupBy(YEAR)
        .agg(F.sum("record_count").alias("record_count"))
        .select(
            YEAR,
            F.lit(months[0]).cast("bigint").alias("period_start_month"),
            F.lit(months[1]).cast("bigint").alias("period_end_month"),
            "record_count",
        )
    )


def check_months(observed: DataFrame, start: str | None, end: str | None) -> None:
    """Refuse missing days and months outside the stated period. Reads the month table only."""
    outside = F.col(MONTH).isNull()
    if start:
        outside |= F.col(MONTH) < start
    if end:
        outside |= F.col(MONTH) > end
    bad = observed.filter(outside).select(MONTH)
    if not bad.filter(F.col(MONTH).isNull()).isEmpty():
        raise StatisticsInput("the opening day must not be missing")
    shown, all_of_them = offenders(bad, "months")
    if shown:
        months = sorted(r[0] for r in shown)
        raise StatisticsInput(f"months outside the stated period: {months} {all_of_them}")


def analyze(df: DataFrame, spec: CatalogSpec, check: bool = True) -> Timeline:
    """One pass over the records; everything else works on the month table."""
    require_columns(df, [spec.opened], StatisticsInput, "timeline input")
    observed = observed_months(df, spec.opened)
    if check:
        observed = observed.persist()
        check_months(observed, spec.period_start, spec.period_end)
    monthly = monthly_counts(observed, spec.period_start, spec.period_end)
    return Timeline(
        monthly,
        annual_summary(monthly, spec.incomplete_years),
        same_period(monthly, spec.comparison_months),
    )
