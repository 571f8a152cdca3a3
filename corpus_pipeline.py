"""A training corpus from ``documents``: five stages, each stored and read again by the next.

1. toxicity: documents scored 0.5 or more leave. 2. n-gram Jaccard join: of each group of linked
documents the one with the smallest doc_id stays. 3. decontamination: documents with a passage of a
benchmark item leave. 4. PII: personal data and terms that disclose it are replaced. 5. BPE: the
encoding of what is left. Every stage works on all its predecessor kept and, but for the last,
returns its input's columns. Null and empty texts stay; rows equal in doc_id and text become one in
stage 2; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import bpe, decontaminate, jaccard, pii, toxicity
from rolecall.llm.common import stored, table, text_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumns({c: F.col(c) for c in docs.columns}), model)
    return scored.filter("predicted = 0").select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of linked ones."""
    kept = jaccard.groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    import public_tokenizers

    texts = docs.select("doc_id", text_of().alias("text"))
    return bpe.encode(texts, public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_leaks),
    ("PII", hide_personal),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs


# The kernel machine, the groups and the tokenizer are beyond SQL: tests compare with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
