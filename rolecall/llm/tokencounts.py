"""Token counts as delta-maintained rollups.

A change is a signed row: +1 with the tokens of a document that comes in, -1 with those of one that
goes; a revised count is both. ``commit`` turns a batch of changes into one delta of additive totals
by source, language and tokenizer version, summed map-side before any shuffle, so a source with a third of
the rows is no burden, and publishes it together with the batch's ledger rows. Totals are the sum of
all deltas; no old batch is read to add a new one.

A batch is published by the one write of its marker, after its files are complete, and readers only
look at marked attempts. A batch_id that is marked is not applied again, and an attempt that was
lost half-way is never read: a repeated commit changes nothing.

Defined results: null source or language is a group of its own; a null or empty text has 0 tokens;
repeated rows count each time; groups whose documents and tokens are all gone have no row; other
columns are ignored.
"""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.llm.common import text_of, with_columns

KEYS = ["source", "lang", "tokenizer_version"]
CHANGE = ["doc_id", *KEYS, "sign", "tokens"]
_CODERS: dict = {}
WORDS_VERSION = "words-1"


def word_count(column: str = "text"):
    """Words: runs without space, tab or line end."""
    return F.size(F.filter(F.split(text_of(column), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def bpe_counted(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``tokens`` of the whole ``text`` by a rank file of byte-level BPE."""

    def compute(batch):
        if path not in _CODERS:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            _CODERS[path] = tiktoken.Encoding(
                "counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
        coder = _CODERS[path]
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return [[len(coder.encode_ordinary(t or "")) for t in texts]]

    return with_columns(rows, [T.StructField("tokens", T.LongType())], compute)


def changes(rows: DataFrame, version: str, sign: int) -> DataFrame:
    """Signed change rows of documents with their ``tokens``."""
    return rows.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.lit(version).alias("tokenizer_version"), F.lit(sign).alias("sign"), F.col("tokens").cast("long"),
    )


def _marked(spark: SparkSession, root: str) -> list[str]:
    """Attempts of the committed batches: the first marker of a batch_id counts."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(path))


def commit(changed: DataFrame, root: str, batch_id: str) -> bool:
    """Apply a batch once; False if it had been applied."""
    spark = changed.sparkSession
    if any(m.split("=")[0] == batch_id for m in _marked(spark, root)):
        return False
    attempt = uuid.uuid4().hex
    folder = f"{root}/deltas/{batch_id}-{attempt}"
    changed.groupBy(*KEYS).agg(
        F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
    ).write.parquet(folder)
    jvm = spark.sparkContext._jvm
    # The marker names batch and attempt; creating it is the commit.
    marker = jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{batch_id}={batch_id}-{attempt}")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(marker, False).close()
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """``documents`` and ``tokens`` by source, language and tokenizer version, over all commits."""
    schema = "source string, lang string, tokenizer_version string, documents long, tokens long"
    first: dict[str, str] = {}
    for mark in _marked(spark, root):
        batch, _, attempt = mark.partition("=")
        first.setdefault(batch, attempt)
    if not first:
        return spark.createDataFrame([], schema)
    deltas = spark.read.schema(schema).parquet(*[f"{root}/deltas/{a}" for a in first.values()])
    return (
        deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        .filter("documents <> 0 OR tokens <> 0")
    )


def compact(spark: SparkSession, root: str, into: str) -> None:
    """Write the present totals as the one batch ``base`` of a new store."""
    folder = f"{into}/deltas/base-0"
    totals(spark, root).write.parquet(folder)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{into}/commits/base=base-0")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(marker, False).close()
