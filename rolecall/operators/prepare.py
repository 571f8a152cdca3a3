"""From raw records to the prepared table: raw columns kept, derived columns appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.errors import RecordMismatch, require_columns
from rolecall.functions.dates import day, month_label, year_number
from rolecall.functions.guards import offenders
from rolecall.functions.text import strip
from rolecall.spec import DAYS, MISTYPED, MONTH, PRODUCT, ROW_INDEX, VENDOR, YEAR, CatalogSpec


def _faults(df: DataFrame, spec: CatalogSpec) -> list[tuple[Column, str]]:
    """(condition, reason) pairs that keep a raw row from being prepared; never null."""
    rules = []
    if spec.tags:
        rules.append((F.col(spec.tags).isNull(), f"{spec.tags} is not a list"))
    for name in filter(None, (spec.vendor, spec.product)):
        rules.append((F.col(name).isNull(), f"{name} is not a string"))
    days = {name: day(df, name) for name in spec.date_fields}
    for name, value in days.items():
        rules.append((value.isNull(), f"{name} is not a date"))
    if spec.due:
        reversed_ = F.coalesce(days[spec.due] < days[spec.opened], F.lit(False))
        rules.append((reversed_, f"{spec.due} precedes {spec.opened}"))
    return rules


def _derive(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    columns = [
        day(df, name).alias(name) if name in spec.date_fields else F.col(name)
        for name in spec.raw_fields
    ]
    opened = day(df, spec.opened)
    labels = ((spec.vendor, VENDOR), (spec.product, PRODUCT))
    columns += [strip(F.col(name)).alias(label) for name, label in labels if name]
    columns += [year_number(opened).alias(YEAR), month_label(opened).alias(MONTH)]
    if spec.due:
        columns.append(F.datediff(day(df, spec.due), opened).cast("bigint").alias(DAYS))
    if spec.tags:
        columns.append((F.size(spec.tags) > 0).alias(spec.has_tags))
        columns.append(F.size(spec.tags).cast("bigint").alias(spec.tag_count))
    return df.select(*columns)


def prepare(
    df: DataFrame, spec: CatalogSpec, mode: str = "quarantine"
) -> tuple[DataFrame, DataFrame]:
    """(prepared, rejected). Narrow: no shuffle, no sort, input order kept.

    ``quarantine`` sets rejected rows aside with their ``reject_reasons``; ``fail`` raises when
    there is any, naming the first few and the table of all.
    """
    if mode not in ("quarantine", "fail"):
        raise ValueError("mode must be 'quarantine' or 'fail'")
    require_columns(df, spec.raw_fields, RecordMismatch, "prepare input")
    faults = _faults(df, spec)
    any_fault = F.lit(False)
    for condition, _ in faults:
        any_fault = any_fault | condition
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in faults]))
    rejected = df.filter(any_fault).withColumn("reject_reasons", reasons)
    if mode == "fail":
        place = ROW_INDEX if ROW_INDEX in df.columns else spec.id
        shown, all_of_them = offenders(rejected.select(place, "reject_reasons"), "prepare")
        if shown:
            raise RecordMismatch(
                "records cannot be prepared",
                rows=[(r[0], list(r.reject_reasons)) for r in shown],
                **all_of_them,
            )
    return _derive(df.filter(~any_fault).drop(MISTYPED), spec), rejected
