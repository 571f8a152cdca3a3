"""Catalog views over the star-schema tables.

Each view joins in only the roles asked for. Joins carry no hints: Spark broadcasts a side
when its measured size allows and otherwise shuffles, with skewed partitions split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators.prepare import prepare
from rolecall.spec import PRODUCT, VENDOR, CatalogSpec

ORDERS = CatalogSpec(
    id="o_orderkey",
    vendor="n_name",
    product="c_mktsegment",
    title="o_orderpriority",
    opened="o_orderdate",
    status="o_orderstatus",
    status_domain=("F", "O", "P"),
    positive_status="F",
    tags="brands",
    tag_pattern=r"Brand#[0-9]+",
    id_label="order",
    tag_label="brand",
)
LINES = CatalogSpec(
    id="line_id",
    vendor="s_name",
    product="p_name",
    opened="o_orderdate",
    due="l_shipdate",
    status="l_returnflag",
    status_domain=("A", "R"),
    positive_status="R",
    id_pattern=r"[0-9]+-[0-9]+",
    id_label="line",
)
DOCUMENTS = CatalogSpec(
    id="doc_id",
    vendor="source",
    product="lang",
    description="text",
    opened="opened",
    status="status",
    status_domain=("Known", "Unknown"),
    positive_status="Known",
    id_label="doc",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customer_labels(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "n_name", "c_mktsegment"
    )


def order_labels_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_name, c_mktsegment, record_count): orders counted per customer before any join.

    A customer with a third of all orders is one row per map task by the time it is shuffled.
    """
    per_customer = (
        table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("record_count"))
    )
    return per_customer.join(_customer_labels(spark, sf_dir), "o_custkey").select(
        F.col("n_name").alias(VENDOR), F.col("c_mktsegment").alias(PRODUCT), "record_count"
    )


def line_labels_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_name, p_name, record_count): lines counted per supplier and part before any join."""
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.count("*").alias("record_count"))
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias(VENDOR)
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias(PRODUCT)
    )
    return counted.join(supplier, "l_suppkey").join(part, "l_partkey").select(
        VENDOR, PRODUCT, "record_count"
    )


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, brands): sorted distinct brands; a set of at most all brands per order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    )


def orders_catalog(
    spark: SparkSession, sf_dir: str, labels: bool = True, tags: bool = True
) -> DataFrame:
    """One prepared row per order; vendor = nation, product = market segment, tags = brands bought."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        "o_orderstatus",
    )
    spec = ORDERS
    if tags:
        df = df.join(order_brands(spark, sf_dir), "o_orderkey", "left").withColumn(
            "brands", F.coalesce("brands", F.array().cast("array<string>"))
        )
    else:
        spec = spec.with_options(tags=None)
    if labels:
        df = df.join(_customer_labels(spark, sf_dir), "o_custkey")
    else:
        spec = spec.with_options(vendor=None, product=None)
    return prepare(df, spec)[0]


def lines_catalog(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """One raw row per order line; ids repeat and many due days precede the opening day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    df = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = [
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.col("l_shipdate").cast("date").alias("l_shipdate"),
        "l_returnflag",
    ]
    if not labels:
        return df.select(*columns)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    df = df.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    df = df.join(part, F.col("l_partkey") == F.col("p_partkey"))
    line_id, opened, due, status = columns
    return df.select(line_id, "s_name", "p_name", opened, due, status)


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared lines without labels: the roles that window statistics read, and no label joins."""
    spec = LINES.with_options(vendor=None, product=None)
    return prepare(lines_catalog(spark, sf_dir, labels=False), spec)[0]


def documents_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; status Known when labelled toxic, Unknown otherwise."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents")
    return docs.join(toxic.withColumn("_toxic", F.lit(1)), "doc_id", "left").select(
        "doc_id",
        "text",
        F.col("source").alias(VENDOR),
        F.when(F.col("_toxic") == 1, "Known").otherwise("Unknown").alias("status"),
    )


def events_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; vendor = event type, product = user."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias(VENDOR),
        F.col("user_id").cast("string").alias(PRODUCT),
        F.col("ts").cast("date").alias("opened"),
    )


# Orders as records of an envelope: every cell is text, as in a JSON feed.
ENVELOPED = CatalogSpec(
    id="o_orderkey",
    vendor="o_custkey",
    product="o_orderpriority",
    opened="o_orderdate",
    status="o_orderstatus",
    status_domain=("F", "O", "P"),
    positive_status="F",
    id_label="order",
)


def order_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, doc VARIANT): one envelope document per order, built where the row lies."""
    text = {"o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")}
    record = F.struct(
        *[text.get(f, F.col(f)).cast("string").alias(f) for f in ENVELOPED.raw_fields]
    )
    envelope = F.struct(
        F.lit("orders").alias("title"),
        F.lit("1").alias("catalogVersion"),
        text["o_orderdate"].alias("dateReleased"),
        F.lit(1).cast("bigint").alias("count"),
        F.array(record).alias("vulnerabilities"),
    )
    # The explode of one document keeps later conditions from repeating the parse.
    doc = F.explode(F.array(F.parse_json(F.to_json(envelope)))).alias("doc")
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("source_file"), doc)


# Order lines as records of an envelope: ids repeat, and some cells and fields break the contract.
LINE_RECORDS = CatalogSpec(
    id="l_orderkey",
    vendor="l_suppkey",
    product="l_partkey",
    opened="l_shipdate",
    status="l_returnflag",
    status_domain=("A", "R"),
    positive_status="R",
    tags="flags",
    id_label="order",
    tag_label="flag",
)


def _quoted(name: str):
    """A text as JSON, null as ``null``; only text with characters to escape goes through a JSON writer."""
    c = F.col(name)
    written = F.to_json(F.array(c))
    escaped = F.substring(written, F.lit(2), F.length(written) - 2)
    plain = F.concat(F.lit('"'), c, F.lit('"'))
    return F.when(c.isNull(), F.lit("null")).when(c.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(plain)


def line_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, doc VARIANT): an envelope per order whose records are the order's lines.

    A document is as large as its order. Records stand by line number, part, supplier and price. What
    breaks the contract follows from the data: line 7 lacks its part, a line without discount has a
    field too many, small quantities state the supplier as a number, a line without tax its flags as
    text, and a quantity of 50 makes the record a bare text. Every 11th order key states its count as
    text, every 13th no version.
    """
    text = F.col("l_suppkey").cast("string")
    supplier = F.when(F.col("l_quantity") < 5, text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    pair = F.concat(F.lit("["), _quoted("l_returnflag"), F.lit(","), _quoted("l_linestatus"), F.lit("]"))
    flags = F.when(F.col("l_tax") == 0, F.concat(F.lit('"'), "l_returnflag", F.lit('"'))).otherwise(pair)
    part = F.when(F.col("l_linenumber") != 7, F.col("l_partkey").cast("string"))
    cells = {
        "l_orderkey": F.concat(F.lit('"'), F.col("l_orderkey").cast("string"), F.lit('"')),
        "l_suppkey": supplier,
        "l_partkey": F.concat(F.lit('"'), part, F.lit('"')),
        "l_shipdate": F.concat(F.lit('"'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('"')),
        "l_returnflag": F.when(F.col("l_returnflag").isNotNull(), _quoted("l_returnflag")),
        "flags": flags,
        "l_comment": F.when(F.col("l_discount") == 0, F.lit('"full price"')),
    }
    # Null cells are left out, as concat_ws does.
    fields = F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), cell) for name, cell in cells.items()])
    record = F.concat(F.lit("{"), fields, F.lit("}"))
    record = F.when(F.col("l_quantity") == 50, F.lit('"a full pallet"')).otherwise(record)
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # Written before the aggregate, whose own arguments would be interpreted.
    written = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*place, record.alias("rec")).alias("line"))
    grouped = written.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    count = F.size("lines").cast("string")
    key = F.col("l_orderkey")
    doc = F.concat(
        F.lit('{"title":"order"'),
        F.when(key % 13 == 0, F.lit("")).otherwise(F.lit(',"catalogVersion":"1"')),
        F.lit(',"dateReleased":"2024-01-01","count":'),
        F.when(key % 11 == 0, F.concat(F.lit('"'), count, F.lit('"'))).otherwise(count),
        F.lit(',"vulnerabilities":['),
        F.array_join(F.col("lines.rec"), ","),
        F.lit("]}"),
    )
    return grouped.select(
        F.lit("lines").alias("source_file"), F.explode(F.array(F.parse_json(doc))).alias("doc")
    )
