"""What a prepared catalog must hold before it is analysed, counted in one pass or while it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.errors import RecordMismatch, StatisticsInput
from rolecall.operators.tags import bad_members
from rolecall.spec import DAYS, MONTH, YEAR, CatalogSpec

TAG_GUARDS = ("tag list missing", "tag members invalid")


def conditions(spec: CatalogSpec) -> dict[str, Column]:
    """Guard name to the condition that breaks it; a condition is never null."""
    status = F.col(spec.status)
    rules = {
        "opening day missing": F.col(spec.opened).isNull(),
        "year missing": F.col(YEAR).isNull(),
        "status missing": status.isNull(),
        "status unsupported": ~status.isin(*spec.status_domain),
    }
    outside = F.lit(False)
    if spec.period_start:
        outside = outside | (F.col(MONTH) < spec.period_start)
    if spec.period_end:
        outside = outside | (F.col(MONTH) > spec.period_end)
    rules["month outside period"] = outside
    if spec.due:
        rules["window missing"] = F.col(DAYS).isNull()
        rules["window negative"] = F.col(DAYS) < 0
    if spec.tags:
        rules["tag list missing"] = F.col(spec.tags).isNull()
        rules["tag members invalid"] = F.size(bad_members(spec)) > 0
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def counts(spec: CatalogSpec) -> list[Column]:
    """One count a guard, in the order of ``conditions``; may be observed during a write."""
    return [F.count_if(rule).alias(name) for name, rule in conditions(spec).items()]


def findings(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """(guard, row_count, first_id): every guard, with the rows that break it and their smallest id.

    One aggregate over the records; only one row a task is shuffled.
    """
    broken = [
        F.struct(
            F.lit(name).alias("guard"),
            F.count_if(rule).alias("row_count"),
            F.min(F.when(rule, F.col(spec.id))).alias("first_id"),
        )
        for name, rule in conditions(spec).items()
    ]
    return df.agg(F.array(*broken).alias("found")).select(F.inline("found"))


def require(counted: dict[str, int]) -> None:
    """Refuse counts of broken guards: tag guards as a record mismatch, others as unfit statistics."""
    broken = {name: n for name, n in counted.items() if n}
    in_tags = {name: n for name, n in broken.items() if name in TAG_GUARDS}
    if in_tags:
        raise RecordMismatch("tags break the contract", rows=in_tags)
    if broken:
        raise StatisticsInput(f"the catalog cannot be analysed: {broken}")
