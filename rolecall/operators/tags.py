"""Multi-label tag statistics: the long (record, tag) table and shares per subset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.errors import MissingColumns, RecordMismatch, require_columns
from rolecall.functions.guards import offenders
from rolecall.functions.text import full_match
from rolecall.operators.status import unsupported_statuses
from rolecall.spec import PRODUCT, ROW_INDEX, VENDOR, CatalogSpec


@dataclass(frozen=True)
class TagResult:
    long_table: DataFrame
    overall: DataFrame
    positive: DataFrame
    other: DataFrame


def long_columns(spec: CatalogSpec) -> list[str]:
    return [spec.id, spec.tag_label, spec.status, spec.opened, VENDOR, PRODUCT]


def bad_members(spec: CatalogSpec):
    """The members of the tag list that are null or do not match the pattern."""
    return F.filter(spec.tags, lambda t: t.isNull() | ~full_match(t, spec.tag_pattern or ".*"))


def check_tags(df: DataFrame, spec: CatalogSpec) -> None:
    """Refuse null lists and bad members, naming the first few rows and the table of all."""
    place = ROW_INDEX if ROW_INDEX in df.columns else spec.id
    no_list = F.col(spec.tags).isNull()
    bad = df.filter(no_list | (F.size(bad_members(spec)) > 0))
    shown = bad.select(F.col(place).alias("place"), no_list.alias("no_list"))
    # Which message it is follows from all offenders: a missing list outweighs bad members.
    rows, all_of_them = offenders(shown.filter("no_list"), "tags")
    if rows:
        raise RecordMismatch(
            f"{spec.tags} must be a list in every row", rows=[r.place for r in rows], **all_of_them
        )
    rows, all_of_them = offenders(shown, "tags")
    if rows:
        raise RecordMismatch(
            f"{spec.tags} has invalid members", rows=[r.place for r in rows], **all_of_them
        )


def long_table(
    df: DataFrame, spec: CatalogSpec, unique_ids: bool = False, check: bool = False
) -> DataFrame:
    """One row per distinct (record id, tag), with four attributes of the record.

    Where ids are known to be unique the list itself is deduplicated and nothing is shuffled.
    Otherwise the first row per (id, tag) is kept by a pre-aggregating minimum: "first" goes
    by ``row_index`` where there is one, else by the attributes.
    """
    require_columns(df, [spec.tags, *long_columns(spec)[:1], *long_columns(spec)[2:]],
                    MissingColumns, "tag input")
    if check:
        check_tags(df, spec)
    columns = long_columns(spec)
    exploded = df.withColumn(spec.tag_label, F.explode(F.array_distinct(spec.tags)))
    if unique_ids:
        return exploded.select(*columns)
    rest = columns[2:]
    order = ([ROW_INDEX] if ROW_INDEX in df.columns else []) + [
        c for c in (spec.opened, spec.status, VENDOR, PRODUCT) if c
    ]
    first = F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])).alias("_first")
    kept = exploded.groupBy(spec.id, spec.tag_label).agg(first)
    return kept.select(
        spec.id, spec.tag_label, *[F.col(f"_first._{order.index(c)}").alias(c) for c in rest]
    )


def in_order(long: DataFrame, spec: CatalogSpec) -> DataFrame:
    return long.orderBy(spec.id, spec.tag_label)


def denominators(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """One row: records with at least one tag, overall, positive and other."""
    tagged = F.size(spec.tags) > 0
    status = F.col(spec.status)
    return df.agg(
        F.count_if(tagged).alias("overall"),
        F.count_if(tagged & (status == spec.positive_status)).alias("positive"),
        F.count_if(tagged & status.isin(*spec.other_statuses)).alias("other"),
    )


def tag_counts(long: DataFrame, spec: CatalogSpec) -> DataFrame:
    """(tag, distinct ids). (id, tag) is unique in the long table, so a plain count is exact and
    a tag carried by a third of the records is summed in parts."""
    return long.groupBy(spec.tag_label).agg(F.count(spec.id).alias(spec.distinct_ids))


def summarize(long: DataFrame, spec: CatalogSpec, denominator, share: str = "share") -> DataFrame:
    """Counts with a share of ``denominator`` (a number or a scalar column).

    A record counts under each of its tags, so shares may add up to more than 1.
    """
    denominator = F.lit(denominator) if isinstance(denominator, int) else denominator
    return tag_counts(long, spec).select(
        spec.tag_label,
        spec.distinct_ids,
        denominator.cast("bigint").alias("denominator"),
        (F.col(spec.distinct_ids) / denominator).alias(share),
    )


def subset(long: DataFrame, spec: CatalogSpec, positive: bool) -> DataFrame:
    wanted = [spec.positive_status] if positive else list(spec.other_statuses)
    return long.filter(F.col(spec.status).isin(*wanted))


def _denominator(df: DataFrame, spec: CatalogSpec, which: str):
    """Stated in the spec, or counted from the records."""
    stated = spec.tag_denominators or {}
    names = {"overall": "overall", "positive": spec.positive_status}
    names["other"] = spec.other_statuses[0] if len(spec.other_statuses) == 1 else "other"
    if names[which] in stated:
        return int(stated[names[which]])
    return denominators(df, spec).select(which).scalar()


def overall(df: DataFrame, long: DataFrame, spec: CatalogSpec) -> DataFrame:
    return summarize(long, spec, _denominator(df, spec, "overall"))


def positive(df: DataFrame, long: DataFrame, spec: CatalogSpec) -> DataFrame:
    part = subset(long, spec, True)
    return summarize(part, spec, _denominator(df, spec, "positive"), f"{spec.positive_key}_share")


def other(df: DataFrame, long: DataFrame, spec: CatalogSpec) -> DataFrame:
    part = subset(long, spec, False)
    return summarize(part, spec, _denominator(df, spec, "other"), f"{spec.other_key}_share")


def top_tags(summary: DataFrame, spec: CatalogSpec, n: int = 20) -> DataFrame:
    return summary.orderBy(F.desc(spec.distinct_ids), spec.tag_label).limit(n)


def compare_shares(
    positive_summary: DataFrame, other_summary: DataFrame, spec: CatalogSpec, n: int = 15
) -> DataFrame:
    """The ``n`` tags with the largest share on either side; absent on one side means 0."""
    a, b = f"{spec.positive_key}_share", f"{spec.other_key}_share"
    both = positive_summary.select(spec.tag_label, a).join(
        other_summary.select(spec.tag_label, b), spec.tag_label, "full_outer"
    )
    both = both.na.fill(0.0, [a, b]).withColumn("max_share", F.greatest(a, b))
    return both.orderBy(F.desc("max_share"), spec.tag_label).limit(n)


def analyze(
    df: DataFrame, spec: CatalogSpec, check: bool = True, unique_ids: bool = False
) -> TagResult:
    """The long table is built once and kept for its three summaries."""
    long = long_table(df, spec, unique_ids, check).persist()
    if check:
        found, all_of_them = offenders(unsupported_statuses(long, spec), "status")
        if found or not long.filter(F.col(spec.status).isNull()).isEmpty():
            raise RecordMismatch(
                "unsupported status values", values=sorted(r[0] or "" for r in found), **all_of_them
            )
    return TagResult(
        in_order(long, spec),
        overall(df, long, spec),
        positive(df, long, spec),
        other(df, long, spec),
    )
