"""Small summaries of a search result: per month, per vendor, per tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.errors import MissingColumns, require_columns
from rolecall.operators.tags import long_table, tag_counts
from rolecall.spec import MONTH, VENDOR, CatalogSpec


def monthly(rows: DataFrame) -> DataFrame:
    """Months that occur, without zero filling."""
    require_columns(rows, [MONTH], MissingColumns, "monthly summary")
    return (
        rows.filter(F.col(MONTH).isNotNull())
        .groupBy(MONTH)
        .agg(F.count("*").alias("record_count"))
        .orderBy(MONTH)
    )


def vendors(rows: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Distinct record ids per vendor, unlike the leaderboard, which counts rows."""
    require_columns(rows, [VENDOR, spec.id], MissingColumns, "vendor summary")
    return (
        rows.filter(F.col(VENDOR).isNotNull())
        .groupBy(VENDOR)
        .agg(F.count_distinct(spec.id).alias("record_count"))
        .orderBy(F.desc("record_count"), VENDOR)
    )


def tags(
    rows: DataFrame, spec: CatalogSpec, unique_ids: bool = False, check: bool = False
) -> DataFrame:
    """Distinct record ids per tag, without a denominator."""
    long = long_table(rows, spec, unique_ids, check)
    return tag_counts(long, spec).orderBy(F.desc(spec.distinct_ids), spec.tag_label)
