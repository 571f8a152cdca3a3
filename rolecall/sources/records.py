"""Record tables outside an envelope: Parquet, JSON lines, and published CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.sources.envelope import checked_records
from rolecall.spec import ROW_INDEX, SOURCE, VULNERABILITY_FEED, CatalogSpec


def read_record_lines(
    spark: SparkSession,
    path,
    spec: CatalogSpec = VULNERABILITY_FEED,
    landing: str | None = None,
) -> DataFrame:
    """One JSON record per line, as strictly as in an envelope. Splittable, so it scales out.

    Lines carry no position, so ``row_index`` is null; the record id names the row.
    """
    lines = spark.read.option("singleVariantColumn", "rec").json(path)
    flat = lines.select(
        F.col("_metadata.file_path").alias(SOURCE), F.lit(None).cast("int").alias(ROW_INDEX), "rec"
    )
    return checked_records(flat, spec, landing, rebalance=False)


def read_record_parquet(spark: SparkSession, path, with_row_index: bool = True) -> DataFrame:
    """Parquet records with a dense ``row_index`` over all files in path order.

    The index comes from file positions, so a repeated read gives the same numbers.
    """
    rows = spark.read.parquet(path)
    if not with_row_index:
        return rows
    names = rows.columns
    rows = rows.select(
        *names,
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.row_index").alias("_position"),
    )
    # One row per file: the file list is already on the driver, so one task can order it.
    before = Window.orderBy(SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(SOURCE).agg((F.max("_position") + 1).alias("_rows"))
    starts = starts.select(SOURCE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    joined = rows.join(starts, SOURCE)
    return joined.select(
        *names, (F.col("_start") + F.col("_position")).cast("bigint").alias(ROW_INDEX), SOURCE
    )


def read_table_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """A published CSV table, with the schema stated rather than guessed."""
    return spark.read.csv(path, header=True, schema=schema, dateFormat="yyyy-MM-dd", multiLine=True,
                          escape='"')
