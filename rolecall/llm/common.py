"""Tables, hand-overs and Arrow helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rolecall.session import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once as Parquet to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash_bucket(column, n: int) -> Column:
    """crc32 of the value's decimal text, modulo ``n``: the folds of labelled rows."""
    return F.crc32(F.col(column).cast("string")) % n


def with_columns(
    df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list]
) -> DataFrame:
    """All columns of ``df`` and the new ones, computed batch by batch beside the rows.

    A column of ``df`` that has a new one's name gives way to it.
    """
    fresh = {f.name for f in fields}
    kept = [f.name for f in df.schema.fields if f.name not in fresh]
    schema = T.StructType([df.schema[n] for n in kept] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                new = compute(batch)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
                columns += [pa.array(v, f.type) for v, f in zip(new, list(arrow)[len(kept):], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)
        finally:
            let_go()

    return df.mapInArrow(run, schema)


_KEPT: list = [None, None]


def kept_in_task(name, make: Callable):
    """What a worker keeps between the batches of one task under ``name``: a single thing, made anew
    for another name or task and let go by ``let_go`` when the task ends."""
    task = TaskContext.get()
    key = (name, task.taskAttemptId() if task else None)
    if _KEPT[0] != key:
        let_go()
        _KEPT[:] = [key, make()]
    return _KEPT[1]


def let_go() -> None:
    _KEPT[:] = [None, None]


class Recent:
    """A memo of two generations, each of about ``most`` bytes: the older one goes when the younger is full.

    An entry is reckoned at ``entry`` bytes and ``per_byte`` for each byte or character of its key."""

    def __init__(self, most: int, entry: int = 300, per_byte: int = 8):
        self.most, self.entry, self.per_byte = most, entry, per_byte
        self.young, self.old = {}, {}

    def missing(self, keys) -> list:
        """Keys without a value; keys found in the old generation move to the young one."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def room(self) -> None:
        """Call between batches: a full young generation becomes the old one."""
        if len(self.young) * self.entry + sum(map(len, self.young)) * self.per_byte > self.most:
            self.young, self.old = {}, self.young


# A key is heavy when it holds more than 1/HEAVY of all rows, so fewer than HEAVY keys are.
HEAVY = 1000


def looked_up(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``values(key, size, ...)``, one row a key, by left join.

    ``size`` says how many of ``rows`` hold the key, ``total`` how many rows there are. The values
    of heavy keys, fewer than HEAVY whatever the data, are broadcast, so no task gathers such a
    key's rows; the other keys are joined by a shuffle in which none is large.
    """
    names = [c for c in values.columns if c not in (key, size)]
    heavy = values.filter(F.col(size) * HEAVY > total).select(
        key, F.struct(*names).alias("_heavy")
    )
    light = values.filter(F.col(size) * HEAVY <= total).select(
        F.col(key).alias("_key"), F.struct(*names).alias("_light")
    )
    found = rows.join(F.broadcast(heavy), key, "left")
    # Rows that have their value go on under a key of their own that matches nothing.
    sought = F.when(F.col("_heavy").isNull(), F.col(key))
    found = found.withColumn("_sought", sought).withColumn(
        "_spread", F.when(F.col("_sought").isNull(), F.rand(7)).otherwise(0.0)
    )
    light = light.withColumn("_zero", F.lit(0.0) * F.xxhash64("_key"))
    found = found.join(
        light, (F.col("_sought") == F.col("_key")) & (F.col("_spread") == F.col("_zero")), "left"
    )
    value = F.coalesce("_heavy", "_light")
    return found.select(*rows.columns, *[value[n].alias(n) for n in names])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) of the undirected ``edges(a, b)``.

    Each round takes the smallest label among the neighbours and then the label's label, so chains
    shorten by more than half a round; each round's labels are stored in the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    labels = stored(
        both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("_near"))
        )
        step = labels.join(near, labels.node == near.a).select(
            "node", "root", F.least("root", "_near").alias("_new")
        )
        jump = labels.select(F.col("node").alias("_at"), F.col("root").alias("_far"))
        new = stored(
            step.join(jump, F.col("_new") == F.col("_at"), "left").select(
                "node", F.least("_new", F.coalesce("_far", "_new")).alias("_root"),
                (F.least("_new", F.coalesce("_far", "_new")) < F.col("root")).alias("_changed"),
            ),
            "labels",
        )
        changed = new.filter("_changed").limit(1).count()
        labels = new.select("node", F.col("_root").alias("root"))
        if not changed:
            return labels


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``rank`` (a row's place in its group, from 0), ``n`` (rows of the group) and ``row``
    (a number that rises with group and order), stored once.

    Rows are sorted by ranges, so a group may span many tasks; a task's rows of a group are counted
    and the counts added up, which are as many as tasks and groups together.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(
        dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    pieces = placed.groupBy(group, "_part").agg(F.min("row").alias("_first"), F.count("*").alias("_rows"))
    so_far = Window.partitionBy(group).orderBy("_part")
    offsets = pieces.select(
        group, "_part", "_first",
        (F.sum("_rows").over(so_far) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    found = placed.join(offsets, [group, "_part"])
    return found.withColumn("rank", F.col("row") - F.col("_first") + F.col("_before")).drop(
        "_part", "_first", "_before"
    )
