"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A window has as many words as a benchmark item (a shorter document is one window). Its distinct weighted
five-word shingles give a 64-bit SimHash; weights are 1 + ln(items / items with the shingle). The
fingerprint is cut in BLOCKS blocks. If two fingerprints differ in at most RADIUS bits, some block
differs in at most RADIUS // BLOCKS bits, so probing every block value within that distance finds
all fingerprints within RADIUS. Candidates are then compared exactly: weighted Jaccard similarity of
window and item, kept at ``least`` or more.

Windows without a single shingle of an item of that length have similarity 0 and get no
fingerprint. Items are sent to the tasks in parts of at most ITEMS; a larger benchmark takes several
passes, so what is broadcast is bounded. Item counts of shingles are those of the whole benchmark: each
part has its shingles' counts with it, and with several parts a first round of passes notes which
shingles of a text the benchmark holds, so every window has its weights whatever the part. Nothing is
shuffled but the matches, and with several parts the texts that share a shingle with an item.

Defined results: null or empty texts and items match nothing; an item of fewer than five words is
one shingle; repeated items each match; repeated rows each match (one row a doc_id and item); of
equally similar windows the first counts; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import stored, text_of
from rolecall.llm.shingles import WORDS, shingle_hashes, word_hashes

BITS, BLOCKS, RADIUS = 64, 6, 23
ITEMS, ITEM_WORDS = 4096, 2_000_000  # of a part: items, and words beyond which it is closed
LEAST = 0.75  # up to rounding
_EDGES = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
_STATE: dict = {}


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int64) * 2 - 1


def _whole(weights: np.ndarray) -> np.ndarray:
    """Weights in 1/1024, so that sums are exact and equal windows have equal fingerprints."""
    return np.rint(weights * 1024).astype(np.int64)


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _repeats(hashes: np.ndarray, signed: np.ndarray, count: int) -> np.ndarray:
    """For each start: the sum of a window's shingles that stand in it before, which count once only."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again, before = order[1:][same], order[:-1][same]
    near = again - before < count
    again, before = again[near], before[near]
    # A repeat lies in the windows that start after again - count and up to its earlier occurrence.
    out = np.zeros((len(hashes) + 1, BITS), dtype=np.int64)
    np.add.at(out, np.maximum(again - count + 1, 0), signed[again])
    np.subtract.at(out, before + 1, signed[again])
    return np.cumsum(out, axis=0, out=out)


def _block(fingerprints: np.ndarray, i: int) -> np.ndarray:
    width = _EDGES[i + 1] - _EDGES[i]
    return (fingerprints >> np.uint64(_EDGES[i])).astype(np.int64) & ((1 << width) - 1)


def _masks(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)])


class Index:
    """Items of a part: shingles, weights, fingerprints and the multi-index tables."""

    def __init__(self, items: list[tuple[int, bytes]], frequency: dict[int, int], n_items: int):
        self.rest = 1 + math.log(max(n_items, 1))
        self.ids, self.sizes, self.sets = [], [], []
        for item_id, text in items:
            words = word_hashes(text)
            if len(words):
                self.ids.append(item_id)
                self.sizes.append(len(words))
                self.sets.append(np.unique(shingle_hashes(words)))
        self.sizes = np.array(self.sizes, dtype=np.int64)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.weight = np.array([1 + math.log(n_items / frequency[int(h)]) for h in self.known])
        self.weights = [self.weight[np.searchsorted(self.known, s)] for s in self.sets]
        self.totals = np.array([w.sum() for w in self.weights])
        self.prints = _fingerprints(np.stack([
            (_signs(s) * _whole(w)[:, None]).sum(axis=0)
            for s, w in zip(self.sets, self.weights, strict=True)
        ])) if self.sets else np.zeros(0, np.uint64)
        # Lengths of the items that hold each shingle.
        self.lengths: list[set[int]] = [set() for _ in self.known]
        for size, s in zip(self.sizes.tolist(), self.sets, strict=True):
            for k in np.searchsorted(self.known, s).tolist():
                self.lengths[k].add(size)
        self.tables = []
        for i in range(BLOCKS):
            width = _EDGES[i + 1] - _EDGES[i]
            near = (_block(self.prints, i)[:, None] ^ _masks(width, RADIUS // BLOCKS)).ravel()
            order = np.argsort(near, kind="stable")
            owner = order // max(1, len(near) // max(1, len(self.ids)))
            self.tables.append((np.searchsorted(near[order], np.arange((1 << width) + 1)), owner))

    def found(self, values: np.ndarray) -> np.ndarray:
        """Place of each shingle among the known ones, -1 where unknown."""
        if not len(self.known):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        return np.where(self.known[at] == values, at, -1)

    def within(self, fingerprint: int, values: list[int], length: int) -> np.ndarray:
        """Items of ``length`` words whose fingerprint is within RADIUS."""
        near = [o[s[v]:s[v + 1]] for (s, o), v in zip(self.tables, values, strict=True)]
        items = np.unique(np.concatenate(near))
        items = items[self.sizes[items] == length]
        return items[np.bitwise_count(self.prints[items] ^ np.uint64(fingerprint)) <= RADIUS]

    def _shingles(self, words: np.ndarray):
        """(size, hashes, places) of the words for every shingle size that items or the text have."""
        if not len(words) or not len(self.known):
            return
        for size in {min(WORDS, s) for s in self.sizes.tolist()} | {min(WORDS, len(words))}:
            if size <= len(words):
                hashes = shingle_hashes(words, size)
                yield size, hashes, self.found(hashes)

    def held(self, text: bytes) -> np.ndarray:
        """The places of the text's shingles among the known ones."""
        found = [p[p >= 0] for _, _, p in self._shingles(word_hashes(text))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, text: bytes, least: float, counts=None) -> dict[int, tuple]:
        """item -> (similarity, first word, words, differing bits) of its best window.

        ``counts``: ascending hashes of the text's shingles that any part holds, and their weights;
        without it, this part is all there is.
        """
        words = word_hashes(text)
        best: dict[int, tuple] = {}
        for size, hashes, place in self._shingles(words):
            hits = np.flatnonzero(place >= 0)
            spans: dict[int, list[int]] = {}
            for h in hits.tolist():
                for length in self.lengths[place[h]]:
                    spans.setdefault(length, []).append(h)
            for length, at in spans.items():
                if size == min(WORDS, length) or len(words) < length:
                    self._windows(hashes, place, length, size, at, least, best, counts)
        return best

    def _windows(self, hashes, place, length, size, hits, least, best, counts) -> None:
        count = min(max(1, length - size + 1), len(hashes))  # shingles of a window
        last = len(hashes) - count
        starts = np.unique(np.clip(
            (np.array(hits)[:, None] - np.arange(count)).ravel(), 0, last
        ))
        # Starts close to each other share one run of sums.
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > count) + 1):
            lo, hi = int(run[0]), int(run[-1]) + count
            known = place[lo:hi]
            weight = np.where(known >= 0, self.weight[known], self.rest)
            if counts is not None and len(counts[0]):
                at = np.minimum(np.searchsorted(counts[0], hashes[lo:hi]), len(counts[0]) - 1)
                weight = np.where((known < 0) & (counts[0][at] == hashes[lo:hi]), counts[1][at], weight)
            sums = np.zeros((hi - lo + 1, BITS), dtype=np.int64)
            signed = _signs(hashes[lo:hi]) * _whole(weight)[:, None]
            np.cumsum(signed, axis=0, out=sums[1:])
            total = sums[run - lo + count] - sums[run - lo]
            prints = _fingerprints(total - _repeats(hashes[lo:hi], signed, count)[run - lo])
            blocks = np.stack([_block(prints, i) for i in range(BLOCKS)], axis=1).tolist()
            for start, p, values in zip(run.tolist(), prints, blocks, strict=True):
                for item in self.within(p, values, length).tolist():
                    window, first = np.unique(hashes[start:start + count], return_index=True)
                    common = np.isin(window, self.sets[item], assume_unique=True)
                    w = weight[first + start - lo]
                    both = w[common].sum()
                    score = float(both / (w.sum() + self.totals[item] - both))
                    if score >= least - 1e-9 and score > best.get(item, (0,))[0]:
                        bits = int(np.bitwise_count(self.prints[item] ^ p))
                        best[item] = (score, start, min(length, count + size - 1), bits)


def _counted(benchmark: DataFrame) -> DataFrame:
    """``item_id, text, counts``: the items, each with its shingles' item counts in the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    items = stored(items.withColumn("key", F.sha1("text")), "items")

    def shingles(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            sets = [np.unique(shingle_hashes(word_hashes(t))).view(np.int64) for t in texts]
            lengths = np.array([len(x) for x in sets], dtype=np.int64)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), lengths)))
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(values, pa.int64())], names=["key", "shingle"])

    held = stored(items.select("key", "text").mapInArrow(shingles, "key string, shingle long"), "shingles")
    number = held.groupBy("shingle").agg(F.count("*").alias("n"))
    counts = held.distinct().join(number, "shingle").groupBy("key").agg(
        F.collect_list(F.struct("shingle", "n")).alias("counts")
    )
    return stored(items.join(counts, "key", "left").drop("key"), "items")


def _parts(items: DataFrame):
    """(items, shingle counts) in bounded parts, read in the order of item_id."""
    part, size, counts = [], 0, {}
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = row.text.encode()
        part.append((row.item_id, text))
        counts.update((c.shingle % 2**64, c.n) for c in row["counts"] or [])
        size += len(text) // 6
        if len(part) == ITEMS or size > ITEM_WORDS:
            yield part, counts
            part, size, counts = [], 0, {}
    if part:
        yield part, counts


def _indexed(sent, tag) -> Index:
    if tag not in _STATE:
        _STATE.clear()
        _STATE[tag] = Index(*sent.value)
    return _STATE[tag]


def _held(texts: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """``texts`` that share a shingle with any item, with ``shingles``: those shingles' hashes and item counts."""
    held = None
    for part, counts in _parts(items):
        sent = texts.sparkSession.sparkContext.broadcast((part, counts, n_items))
        tag = uuid.uuid4().hex

        def run(batches, sent=sent, tag=tag):
            index = _indexed(sent, tag)
            frequency = sent.value[1]
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    values = index.known[index.held(text or b"")]
                    n = [frequency[h] for h in values.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(n), pa.string()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())],
                        names=["key", "shingle", "n"],
                    )

        one = texts.select(F.sha1("text").alias("key"), "text").mapInArrow(run, "key string, shingle long, n long")
        held = one if held is None else held.unionByName(one)
    of = held.distinct().groupBy("key").agg(F.collect_list(F.struct("shingle", "n")).alias("shingles"))
    return stored(texts.withColumn("key", F.sha1("text")).join(of, "key").drop("key"), "held")


def matches(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words, hamming`` of each document's items."""
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, similarity double, start_word int, n_words int, hamming int"
    items = _counted(benchmark)
    n_items = max(items.count(), 1)
    found = spark.createDataFrame([], schema)
    texts = documents.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    several = len(list(islice(_parts(items), 2))) > 1
    if several:
        texts = _held(texts, items, n_items)
    for part, counts in _parts(items):
        sent = spark.sparkContext.broadcast((part, counts, n_items))
        tag = uuid.uuid4().hex

        def run(batches, sent=sent, tag=tag):
            index = _indexed(sent, tag)
            for batch in batches:
                rows = []
                ids = batch.column(0).to_pylist()
                shared = batch.column(2).to_pylist() if several else [None] * len(ids)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for doc, text, own in zip(ids, texts, shared, strict=True):
                    known = None
                    if own is not None:
                        hashes = np.array([c["shingle"] for c in own], dtype=np.int64).view(np.uint64)
                        order = np.argsort(hashes)
                        weights = 1 + np.log(n_items / np.array([c["n"] for c in own], dtype=np.float64))
                        known = hashes[order], weights[order]
                    for item, best in index.matches(text or b"", least, known).items():
                        rows.append((doc, index.ids[item], *best))
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        names=["doc_id", "item_id", "similarity", "start_word", "n_words", "hamming"],
                    )

        found = found.unionByName(texts.mapInArrow(run, schema))
    best = F.max_by(F.struct("similarity", "start_word", "n_words", "hamming"),
                    F.struct("similarity", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents without a match, all columns kept."""
    bad = matches(documents, benchmark, least).select(F.col("doc_id").alias("_bad")).distinct()
    return documents.join(bad, documents.doc_id.cast("long").eqNullSafe(bad["_bad"]), "left_anti")
