"""Joins and running totals that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.session import cut_lineage

# A group is "hot" when it holds more than 1/MAX_HOT of the grouped rows, so there are
# fewer than MAX_HOT hot groups whatever the data: the broadcast below has a fixed bound.
MAX_HOT = 1000


def keep_members(rows: DataFrame, groups: DataFrame, key: str, size: str = "n") -> DataFrame:
    """Rows whose key occurs in ``groups(key, size)``, which has one row per key.

    ``rows`` holds no null keys and no frequent key outside ``groups``. Hot keys are found
    map-side against a bounded broadcast; their rows get the partition they come from as a
    salt, so they spread over the shuffle. The largest group left is 1/MAX_HOT of the rows.
    The salt is the same when a task is repeated, so a lost executor changes nothing.
    """
    total = groups.agg(F.sum(size)).scalar()
    is_hot = F.col(size) * MAX_HOT > total
    hot = groups.filter(is_hot).select(key, F.lit(True).alias("_hot"))
    # The salt is mixed with the key: a bare constant on one side would be folded away and
    # the rows shuffled by key alone.
    cold = groups.filter(~is_hot).select(
        key, F.xxhash64(key, F.lit(0)).alias("_spread"), F.lit(True).alias("_cold")
    )
    salt = F.when(F.col("_hot"), F.spark_partition_id() + 1).otherwise(0)
    return (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_spread", F.xxhash64(key, salt))
        .join(cold, [key, "_spread"], "left")
        .filter(F.col("_hot") | F.col("_cold"))
        .select(*rows.columns)
    )


def running_total(df: DataFrame, value: str, order, into: str) -> DataFrame:
    """``into`` = sum of ``value`` over all rows up to this one in ``order`` (a total order).

    ``df`` is cut into ranges, summed per range and shifted by the sums before it.
    """
    # The cut into ranges is stored before use, so both readers below see the same ranges.
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # One row per range: as many rows as partitions, hence one small task.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.sum(value).alias("_sum"))
    offsets = offsets.select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_range").orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranges.join(F.broadcast(offsets), "_range")
        .withColumn(into, F.col("_offset") + F.sum(value).over(within))
        .drop("_range", "_offset")
    )
