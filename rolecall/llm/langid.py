"""Language identification by nearest TF-IDF centroids, with rejection by distance.

A text's vector counts its 1- to 3-grams of lower-cased letters (everything else is one blank),
hashed into DIMENSIONS places, with sub-linear counts, inverse document frequencies over all
training documents, and unit length. Each language has up to CENTROIDS centroids, found by spherical
k-means. A text gets the language of the centroid with the largest cosine. Its ``distance`` is one
less that cosine; it is ``rejected`` when farther than nearly all training documents of that language
are (the REJECT quantile): the prediction stays, marked as doubtful.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
first language in alphabetical order; without training rows all are ``und``; repeated rows get equal
results and count once in the fit; clashing columns give way; rows without a doc_id are learnt from and
not held out. Centroids are fitted on at most ``max_rows`` documents a language, picked by a hash of doc_id
and text; frequencies and predictions use every whole text.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.llm.common import hash_bucket, stored, text_of, with_columns

DIMENSIONS, CENTROIDS, FOLDS = 1 << 13, 4, 4
REJECT = 0.995
SHARPNESS = 24.0  # of the score: a soft maximum over languages
UNKNOWN = "und"
_LETTERS: list = []


def _letters() -> np.ndarray:
    """Code point -> itself for a lower-case letter, 0 for anything else."""
    if not _LETTERS:
        table = np.zeros(0x110000, dtype=np.uint32)
        for start, stop in ((0, 0x20000), (0x20000, 0x33480)):
            for c in range(start, stop):
                if unicodedata.category(chr(c))[0] == "L":
                    table[c] = c
        _LETTERS.append(table)
    return _LETTERS[0]


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts; None without a letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = _letters()[raw]
    if not codes.any():
        return None
    keep = (codes > 0) | (np.r_[np.uint32(1), codes[:-1]] > 0)  # one blank for a run of others
    codes = np.r_[np.uint32(0), codes[keep], np.uint32(0)].astype(np.uint32)
    one = codes * np.uint32(2654435761)
    two = (one[:-1] ^ (codes[1:] * np.uint32(40503) + np.uint32(977))) * np.uint32(2246822519)
    three = (two[:-1] ^ (codes[2:] * np.uint32(30011) + np.uint32(7919))) * np.uint32(3266489917)
    total = np.zeros(DIMENSIONS)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    for grams in (one[codes > 0], two, three):
        total += np.bincount(grams >> shift, minlength=DIMENSIONS)
    return total


def _vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every place, and the number of documents, over all ``texts``.

    Each task sends one array of DIMENSIONS counts; they are summed in Spark, place by place.
    """

    def run(batches):
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = counts(text or "")
                if c is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.r_[n, total])], names=["place", "n"]
        )

    rows = texts.select(text_of().alias("text")).mapInArrow(run, "place long, n long")
    found = rows.groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 rows
    out = np.zeros(DIMENSIONS)
    n = 0
    for r in found:
        if r.place < 0:
            n = r.n
        else:
            out[r.place] = r.n
    return out, n


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from evenly spread rows of a fixed order."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for j in range(k):
            if (own == j).any():
                centres[j] = x[own == j].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    def __init__(self, languages, idf, centres, owner, limits):
        self.languages, self.idf, self.centres = languages, idf, centres
        self.owner, self.limits = owner, limits

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, distance, rejected)."""
        count = counts(text or "")
        if count is None or not self.languages:
            return UNKNOWN, 0.0, 1.0, True
        cosines = self.centres @ _vector(count, self.idf)
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.owner, cosines)
        i = int(best.argmax())
        odds = np.exp(SHARPNESS * (best - best[i]))
        distance = float(1 - best[i])
        return self.languages[i], float(1 / odds.sum()), distance, distance > self.limits[i]


def _sampled(rows: DataFrame, max_rows: int) -> dict[str, list[np.ndarray]]:
    """Counts of up to ``max_rows`` different documents a language, in the order of a hash of doc_id and text.

    Only ids are ranked; the chosen ones, ``max_rows`` a language, find their texts, and of a text only
    its counts leave the task, so what reaches the driver depends neither on the number of documents
    nor on their length.
    """
    named = rows.select(
        "lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), text_of().alias("text"),
        F.xxhash64(F.col("doc_id").cast("string"), text_of()).alias("place"), F.xxhash64(text_of()).alias("same"),
    )
    key = ["lang", "place", "doc", "same"]
    order = Window.partitionBy("lang").orderBy(*key[1:])
    ids = stored(named.select(*key).distinct(), "ids")
    share = ids.groupBy("lang").agg(F.least(F.lit(4.0 * max_rows) / F.count("*"), F.lit(1.0)).alias("_share"))
    # Hashes are even, so this leaves about 4 * max_rows of a large language and all of a small one.
    low = ids.join(F.broadcast(share), "lang").filter(F.col("place") / F.lit(2.0**64) + 0.5 <= F.col("_share"))
    ids = low.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_rows).select(*key)
    # A text that stands in repeated rows is taken once.
    texts = named.join(F.broadcast(ids), key, "left_semi").dropDuplicates(key)

    def run(batches):
        for batch in batches:
            found = [counts(t) for t in batch.column(4).to_pylist()]
            data = [None if c is None else zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(data, pa.binary())], names=[*key, "counts"]
            )

    out: dict[str, list[np.ndarray]] = {}
    sent = texts.select(*key, "text").mapInArrow(run, "lang string, place long, doc string, same long, counts binary")
    for r in sorted(sent.collect(), key=lambda r: (r.lang, r.place, r.doc, r.same)):
        if r.counts is not None:
            c = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32).astype(float)
            out.setdefault(r.lang, []).append(c)
    return out


def fit(documents: DataFrame, max_rows: int = 600) -> Model:
    """Learn from text and lang of the rows outside the held-out fold."""
    rows = documents.filter("lang IS NOT NULL").filter(
        hash_bucket("doc_id", FOLDS).isNull() | (hash_bucket("doc_id", FOLDS) != 2)
    ).withColumn("lang", F.col("lang").cast("string"))
    df, n = frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    known, centres, owner, limits = [], [], [], []
    for lang, found in _sampled(rows, max_rows).items():
        x = np.stack([_vector(c, idf) for c in found])
        own = _clustered(x, CENTROIDS)
        limits.append(float(np.quantile(1 - (x @ own.T).max(axis=1), REJECT)))
        owner += [len(known)] * len(own)
        known.append(lang)
        centres.append(own)
    stacked = np.concatenate(centres) if centres else np.zeros((0, DIMENSIONS), np.float32)
    return Model(known, idf, stacked, np.array(owner, dtype=int), limits)


FIELDS = [
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("distance", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
]


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Every row with the predicted language, score, distance and rejection."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def compute(batch):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = [sent.value.predict(t) for t in texts]
        return [list(c) for c in zip(*found, strict=True)]

    return with_columns(documents, FIELDS, compute)
