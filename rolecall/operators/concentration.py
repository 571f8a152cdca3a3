"""Vendor and product leaderboards, cumulative share and concentration.

All tables derive from one count per (vendor, product), so the records are read once and a
dominant vendor is spread over its products before it is ever summed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.errors import StatisticsInput, require_columns
from rolecall.functions.hotkeys import running_total
from rolecall.functions.text import is_blank
from rolecall.session import cut_lineage
from rolecall.spec import PRODUCT, VENDOR

SCOPE = (
    "Concentration of catalog records over vendor labels; "
    "says nothing about market share or product security."
)


@dataclass(frozen=True)
class Concentration:
    vendors: DataFrame
    products: DataFrame
    top_products: DataFrame
    metrics: DataFrame
    hierarchy: DataFrame
    product_counts: DataFrame


def pair_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """(vendor, product, record_count). ``weight`` names a count column of pre-counted input."""
    n = F.sum(weight) if weight else F.count("*")
    return df.groupBy(VENDOR, PRODUCT).agg(n.alias("record_count"))


def vendor_counts(pairs: DataFrame) -> DataFrame:
    """(vendor, record_count, product_count); records without a vendor are not ranked."""
    return (
        pairs.filter(F.col(VENDOR).isNotNull())
        .groupBy(VENDOR)
        .agg(
            F.sum("record_count").alias("record_count"),
            F.count(PRODUCT).alias("product_count"),
        )
    )


def _total(pairs: DataFrame):
    return pairs.filter(F.col(VENDOR).isNotNull()).agg(F.sum("record_count")).scalar()


def vendor_summary(pairs: DataFrame) -> DataFrame:
    """Leaderboard with share and cumulative share in rank order (count, then name).

    The vendor table is stored once for the running sum and the total. The sum adds integers and divides once, so the last share is exactly 1.
    """
    vendors = cut_lineage(vendor_counts(pairs))
    order = [F.desc("record_count"), F.asc(VENDOR)]
    ranked = running_total(vendors, "record_count", order, "_running")
    total = _total(vendors)
    return ranked.select(
        VENDOR,
        "record_count",
        (F.col("record_count") / total).alias("share"),
        (F.col("_running") / total).alias("cumulative_share"),
        "product_count",
    )


def vendor_curve(pairs: DataFrame) -> DataFrame:
    """Rank and cumulative share of every vendor, the points of the concentration curve."""
    order = [F.desc("record_count"), F.asc(VENDOR)]
    ranked = running_total(vendor_summary(pairs).withColumn("_one", F.lit(1)), "_one", order, "rank")
    return ranked.select(F.col("rank").cast("bigint"), VENDOR, "record_count", "cumulative_share")


def product_summary(pairs: DataFrame) -> DataFrame:
    named = pairs.filter(F.col(VENDOR).isNotNull() & F.col(PRODUCT).isNotNull())
    return named.withColumn("share", F.col("record_count") / _total(pairs))


def top_products(pairs: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` vendor-product pairs with their rank and display label."""
    order = [F.desc("record_count"), F.asc(VENDOR), F.asc(PRODUCT)]
    best = product_summary(pairs).orderBy(*order).limit(n)
    # The window sees the n rows of the report, nothing more.
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return best.select(rank.alias("rank"), VENDOR, PRODUCT, "record_count", "share").withColumn(
        "label", F.concat_ws(" - ", VENDOR, PRODUCT)
    )


def top_vendors(pairs: DataFrame, n: int = 15) -> DataFrame:
    order = [F.desc("record_count"), F.asc(VENDOR)]
    best = vendor_counts(pairs).orderBy(*order).limit(n)
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return best.select(rank.alias("rank"), VENDOR, "record_count", "product_count")


def metrics(pairs: DataFrame, scope: str = SCOPE) -> DataFrame:
    """CR5, CR10 and HHI (0..1) as long rows. Sums are exact integers, divided once."""
    vendors = vendor_counts(pairs)
    best = vendors.orderBy(F.desc("record_count"), F.asc(VENDOR)).limit(10)
    rank = F.row_number().over(Window.orderBy(F.desc("record_count"), F.asc(VENDOR)))
    top = best.select("record_count", rank.alias("_rank")).agg(
        F.sum(F.when(F.col("_rank") <= 5, F.col("record_count"))).alias("_top5"),
        F.sum("record_count").alias("_top10"),
    )
    wide = F.col("record_count").cast("decimal(19,0)")
    sums = vendors.agg(
        F.sum(wide * wide).cast("double").alias("_squares"),
        F.sum("record_count").cast("double").alias("_total"),
    ).select(
        "_squares",
        "_total",
        top.select("_top5").scalar().alias("_top5"),
        top.select("_top10").scalar().alias("_top10"),
    )
    rows = sums.filter("_total IS NOT NULL").selectExpr(
        "stack(3, 'CR5', _top5 / _total, 1L, 'CR10', _top10 / _total, 2L,"
        " 'HHI', _squares / (_total * _total), 3L) AS (metric, value, metric_order)"
    )
    return rows.select("metric", "value", F.lit(scope).alias("interpretation_scope"), "metric_order")


def hierarchy(pairs: DataFrame) -> DataFrame:
    """Totals for all records, each vendor and each vendor-product pair; ``level`` 0, 1, 2."""
    rolled = pairs.rollup(VENDOR, PRODUCT).agg(
        F.sum("record_count").alias("record_count"), F.grouping_id().alias("_bits")
    )
    level = F.when(F.col("_bits") == 3, 0).when(F.col("_bits") == 1, 1).otherwise(2)
    return rolled.select(VENDOR, PRODUCT, "record_count", level.cast("bigint").alias("level"))


def product_count_distribution(pairs: DataFrame) -> DataFrame:
    """How many vendors have how many distinct products."""
    return vendor_counts(pairs).groupBy("product_count").agg(F.count("*").alias("vendor_count"))


def check_pairs(pairs: DataFrame) -> None:
    row = pairs.agg(
        F.count("*").alias("groups"),
        F.count_if(is_blank(pairs, VENDOR) | is_blank(pairs, PRODUCT)).alias("blank"),
    ).first()
    if row.groups == 0:
        raise StatisticsInput("vendor statistics need at least one record")
    if row.blank:
        raise StatisticsInput(f"{VENDOR} and {PRODUCT} must be non-empty strings")


def analyze(df: DataFrame, check: bool = True, weight: str | None = None) -> Concentration:
    require_columns(df, [VENDOR, PRODUCT], StatisticsInput, "vendor input")
    pairs = pair_counts(df, weight).persist()
    if check:
        check_pairs(pairs)
    return Concentration(
        vendor_summary(pairs),
        product_summary(pairs),
        top_products(pairs),
        metrics(pairs),
        hierarchy(pairs),
        product_count_distribution(pairs),
    )
