"""Distribution of the opening-to-due window in whole days.

Every statistic derives from one table of (year, days, count). It has at most one row per
year and day length, so percentiles over it stay small however many records there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.errors import StatisticsInput, require_columns
from rolecall.spec import DAYS, YEAR

# Right-closed day bands and the metric names in their order.
BANDS = (("0-7", None, 7), ("8-14", 7, 14), ("15-30", 14, 30), ("31-60", 30, 60), ("61+", 60, None))
METRICS = ("minimum", "first_quartile", "median", "mean", "third_quartile", "maximum")
QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class Durations:
    descriptive: DataFrame
    frequency: DataFrame
    by_year: DataFrame
    bands: DataFrame
    box: DataFrame


def window_counts(df: DataFrame) -> DataFrame:
    """(added_year, deadline_days, n): the only pass over the records."""
    return df.groupBy(YEAR, DAYS).agg(F.count("*").alias("n"))


def _quartiles():
    return F.percentile(DAYS, F.array(*[F.lit(q) for q in QUARTILES]), F.col("n"))


def _six_numbers(counts):
    """min, quartiles, mean and max of a (grouped) frequency table as plain aggregates."""
    return [
        F.min(DAYS).cast("double").alias("min_days"),
        _quartiles().alias("_q"),
        (F.sum(F.col(DAYS) * F.col("n")) / F.sum("n")).alias("mean_days"),
        F.max(DAYS).cast("double").alias("max_days"),
        F.sum("n").alias("record_count"),
    ]


def by_year(counts: DataFrame) -> DataFrame:
    six = counts.groupBy(YEAR).agg(*_six_numbers(counts))
    return six.select(
        YEAR,
        "record_count",
        "min_days",
        F.col("_q")[0].alias("q1_days"),
        F.col("_q")[1].alias("median_days"),
        "mean_days",
        F.col("_q")[2].alias("q3_days"),
        "max_days",
    )


def frequency(counts: DataFrame) -> DataFrame:
    days = counts.groupBy(DAYS).agg(F.sum("n").alias("record_count"))
    total = counts.agg(F.sum("n")).scalar()
    return days.withColumn("share", F.col("record_count") / total)


def descriptive(counts: DataFrame) -> DataFrame:
    """Six long rows (metric, value) with ``metric_order``."""
    row = counts.groupBy(DAYS).agg(F.sum("n").alias("n")).agg(*_six_numbers(counts))
    row = row.filter("record_count IS NOT NULL")
    values = ["min_days", "_q[0]", "_q[1]", "mean_days", "_q[2]", "max_days"]
    pairs = ", ".join(
        f"'{m}', {v}, {i}L" for i, (m, v) in enumerate(zip(METRICS, values, strict=True), 1)
    )
    return row.selectExpr(f"stack({len(METRICS)}, {pairs}) AS (metric, value, metric_order)")


def bands_by_year(counts: DataFrame) -> DataFrame:
    """Year rows, one count column per band, zeros included. The first band also holds day 0."""
    cells = []
    for label, above, upto in BANDS:
        inside = F.lit(True)
        if above is not None:
            inside &= F.col(DAYS) > above
        if upto is not None:
            inside &= F.col(DAYS) <= upto
        cells.append(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(label))
    return counts.groupBy(YEAR).agg(*cells)


def box_summary(counts: DataFrame) -> DataFrame:
    """One row: quartiles and the whiskers, the extreme days within 1.5 IQR of the box."""
    days = counts.groupBy(DAYS).agg(F.sum("n").alias("n"))
    box = days.agg(_quartiles().alias("_q")).filter("_q IS NOT NULL")
    box = box.select(*[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    # One box row beside at most one row per day length; the bounds arrive as scalars.
    low = box.select(F.col("q1") - reach).scalar()
    high = box.select(F.col("q3") + reach).scalar()
    inside = (F.col(DAYS) >= low) & (F.col(DAYS) <= high)
    return days.agg(
        F.min(F.when(inside, F.col(DAYS))).cast("double").alias("lower_whisker"),
        _quartiles().alias("_q"),
        F.max(F.when(inside, F.col(DAYS))).cast("double").alias("upper_whisker"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outlier_count"),
    ).select(
        "lower_whisker",
        F.col("_q")[0].alias("q1"),
        F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q3"),
        "upper_whisker",
        "outlier_count",
    )


def check_counts(counts: DataFrame) -> None:
    """Refuse missing or negative windows and an empty input. Reads the small table only."""
    row = counts.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col(DAYS).isNull() | F.col(YEAR).isNull()).alias("missing"),
        F.count_if(F.col(DAYS) < 0).alias("negative"),
        F.count_if(F.col(DAYS) != F.round(DAYS)).alias("fractional"),
    ).first()
    if row.groups == 0:
        raise StatisticsInput("window statistics need at least one record")
    if row.missing:
        raise StatisticsInput(f"{DAYS} and {YEAR} must not be missing")
    if row.negative:
        raise StatisticsInput(f"{DAYS} must not be negative")
    if row.fractional:
        raise StatisticsInput(f"{DAYS} must be whole days")


def analyze(df: DataFrame, check: bool = True) -> Durations:
    require_columns(df, [DAYS, YEAR], StatisticsInput, "duration input")
    counts = window_counts(df)
    if check:
        counts = counts.persist()
        check_counts(counts)
    return Durations(
        descriptive(counts),
        frequency(counts),
        by_year(counts),
        bands_by_year(counts),
        box_summary(counts),
    )
