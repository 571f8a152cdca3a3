"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (local runs and tests) a folder of our own is used.
    """
    current = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint: the result is stored once and survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df, name: str) -> str:
    """Write ``df`` once as Parquet to the shared checkpoint folder; the path."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def local_session(cores="8", partitions="8", memory="8g", name="rolecall") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
