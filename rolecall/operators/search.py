"""AND-combined search over a prepared catalog, as predicates Spark can push down."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.errors import BadDateRange, BadStatus, BadTag, MissingColumns, require_columns
from rolecall.functions.guards import offenders
from rolecall.functions.text import contains_ci
from rolecall.spec import PRODUCT, ROW_INDEX, VENDOR, YEAR, CatalogSpec


@dataclass(frozen=True)
class Criteria:
    """Every field is optional; those given must all hold."""

    start_date: object = None
    end_date: object = None
    vendor: str | None = None
    product: str | None = None
    status: str | None = None
    tag: str | None = None


def _to_day(value, name: str) -> date | None:
    """The calendar day of a driver-side argument; a time zone is dropped, not converted."""
    if value is None:
        return None
    try:
        stamp = pd.Timestamp(value)
    except (TypeError, ValueError) as err:
        raise BadDateRange(f"{name} is not a date", **{name: str(value)}) from err
    if pd.isna(stamp):
        raise BadDateRange(f"{name} is not a date", **{name: str(value)})
    return stamp.replace(tzinfo=None).date()


def _needle(value, name: str) -> str | None:
    """Stripped text; blank means no condition."""
    if value is None:
        return None
    if not isinstance(value, str):
        raise TypeError(f"{name} must be text, not {value!r}")
    return value.strip() or None


@dataclass(frozen=True)
class Conditions:
    """Checked criteria, ready to become one boolean column."""

    start: date | None
    end: date | None
    vendor: str | None
    product: str | None
    status: str | None
    tag: str | None

    def column(self, spec: CatalogSpec, columns) -> Column:
        parts = []
        if self.start:
            parts.append(F.col(spec.opened) >= F.lit(self.start))
        if self.end:
            parts.append(F.col(spec.opened) <= F.lit(self.end))
        # A day range alone does not prune partitions laid out by year; the year bounds do.
        if YEAR in columns and self.start:
            parts.append(F.col(YEAR) >= self.start.year)
        if YEAR in columns and self.end:
            parts.append(F.col(YEAR) <= self.end.year)
        if self.vendor:
            parts.append(contains_ci(VENDOR, self.vendor))
        if self.product:
            parts.append(contains_ci(PRODUCT, self.product))
        if self.status is not None:
            parts.append(F.col(spec.status) == self.status)
        if self.tag:
            parts.append(F.array_contains(spec.tags, self.tag))
        # A bare AND: each part can be pushed to the scan. Null counts as not met.
        met = F.lit(True)
        for part in parts:
            met = met & part
        return met


def conditions(criteria: Criteria, spec: CatalogSpec) -> Conditions:
    """Check the arguments in a fixed order: dates, vendor, status, tag, product."""
    start = _to_day(criteria.start_date, "start_date")
    end = _to_day(criteria.end_date, "end_date")
    if start and end and start > end:
        raise BadDateRange("start_date is after end_date", start_date=str(start), end_date=str(end))
    vendor = _needle(criteria.vendor, "vendor")
    if criteria.status is not None and criteria.status not in spec.status_domain:
        raise BadStatus("status is outside the domain", status=criteria.status)
    tag = _needle(criteria.tag, "tag")
    if tag:
        tag = tag.upper() if spec.upper_tags else tag
        if not re.fullmatch(spec.tag_pattern or ".*", tag):
            raise BadTag("tag does not match the pattern", tag=criteria.tag)
    product = _needle(criteria.product, "product")
    return Conditions(start, end, vendor, product, criteria.status, tag)


def check_lists(df: DataFrame, spec: CatalogSpec) -> None:
    """A tag search needs a list in every row. One column, null counts prune most of the scan."""
    place = ROW_INDEX if ROW_INDEX in df.columns else spec.id
    bad, all_of_them = offenders(df.filter(F.col(spec.tags).isNull()).select(place), "search")
    if bad:
        raise MissingColumns(
            "a tag search needs a list in every row", rows=[r[0] for r in bad], **all_of_them
        )


def summary(rows: DataFrame, spec: CatalogSpec) -> DataFrame:
    """One row: records, distinct vendors, latest opening day, positive records."""
    return rows.agg(*summary_columns(spec))


def summary_columns(spec: CatalogSpec) -> list[Column]:
    return [
        F.count("*").alias("record_count"),
        F.count_distinct(VENDOR).alias("vendor_count"),
        F.max(spec.opened).alias("max_date"),
        F.count_if(F.col(spec.status) == spec.positive_status).alias(f"{spec.positive_key}_count"),
    ]


def in_order(rows: DataFrame, spec: CatalogSpec) -> DataFrame:
    return rows.orderBy(F.desc(spec.opened), F.asc(spec.id))


def matching(df: DataFrame, spec: CatalogSpec, criteria: Criteria, checked: bool = False):
    """The matching rows, unsorted. ``checked`` says the tag lists are known to be present."""
    wanted = conditions(criteria, spec)
    if wanted.tag and not checked:
        check_lists(df, spec)
    return df.filter(wanted.column(spec, df.columns))


def search(
    df: DataFrame, spec: CatalogSpec, criteria: Criteria | None = None, checked: bool = False,
    **fields
) -> tuple[DataFrame, DataFrame]:
    """(rows, latest first then by id; one-row summary). The summary never sees the sort."""
    require_columns(df, spec.prepared_fields, MissingColumns, "search input")
    criteria = criteria or Criteria(**fields)
    rows = matching(df, spec, criteria, checked)
    return in_order(rows, spec), summary(rows, spec)


def by_id(df: DataFrame, spec: CatalogSpec, value) -> DataFrame:
    """Point lookup."""
    return df.filter(F.col(spec.id) == F.lit(value))
