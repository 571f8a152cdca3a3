"""Toxicity scores: a subsequence string-kernel SVM with Nystroem landmarks.

A text is a bag of terms (white-space words without edge punctuation, runs of single letters
joined, very long words cut into overlapping windows). Two terms are compared by the gap-weighted
subsequence kernel: every three characters in order, at most SPAN characters apart, count
DECAY ** span, so characters put in between or left out lower the similarity without ending it.
Terms carry boundary marks. Nystroem landmarks make the kernel linear, and since the kernel is an
inner product over triples, the whole expansion folds into one weight per triple: scoring a term
costs as many look-ups as it has triples, whatever the number of landmarks.

Labels belong to documents, so training is multi-instance: each term window of a clean document is
clean; of a toxic one at least one window (the witness, chosen anew each round) is toxic. A document's
margin is its largest term margin; Platt scaling turns it into a score.

Defined results: null and empty texts have the margin of no term at all and get the score of the
lowest margin; repeated rows are scored alike; without labels of both classes every score is 0.
Clashing columns named like an output give way. The fit uses at most ``max_bags`` documents a
class, picked by a hash of doc_id, and of their clean windows ``negatives``, picked by a hash, and each round
the ``hard`` ones that come out highest; scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.llm.common import Recent, hash_bucket, kept_in_task, text_of, with_columns

WIDTH = 24  # characters of a term window
SPAN = 5  # largest distance of a triple's first and last character
DECAY = 0.6
ALPHABET = 48
FOLDS = 5
_SINGLES = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_EDGES = ".,;:!?\"'()[]{}<>«»“”’…*_-"
_OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
_CODES: list = []


def _codes() -> np.ndarray:
    """Character -> code: 0 padding, 1 boundary, 2-27 letters, 28 digits, 29 signs, rest by number."""
    if not _CODES:
        table = (np.arange(0x110000) % (ALPHABET - 30) + 30).astype(np.int32)
        table[:128] = 29
        table[0] = 0
        table[ord("0"):ord("9") + 1] = 28
        table[ord("a"):ord("z") + 1] = np.arange(2, 28)
        table[1] = 1
        _CODES.append(table)
    return _CODES[0]


def text_terms(text: str) -> set[str]:
    low = text.lower()
    words = set(low.split())
    # A spelled-out word has at least three different letters; most texts need no closer look.
    if sum(len(w) == 1 for w in words) >= 3:
        words.update(m[0].replace(" ", "") for m in _SINGLES.finditer(low))
    return words


def _windows(word: str) -> list[str]:
    core = word.strip(_EDGES) or word
    if len(core) <= WIDTH:
        return [core]
    return [core[i:i + WIDTH] for i in range(0, len(core) - WIDTH // 2, WIDTH // 2)]


def _matrix(terms: list[str], width: int = WIDTH) -> np.ndarray:
    width = max(width, 2) + 2
    marked = np.array(["\1" + t.replace("\0", "") + "\1" for t in terms], dtype=f"U{width}")
    return _codes()[marked.view(np.uint32).reshape(len(terms), width)]


def _triples(m: np.ndarray):
    """(triple codes, weight) of each offset pair; triples with padding get code 0."""
    for a, b in _OFFSETS:
        if b >= m.shape[1]:
            continue
        first, mid, last = m[:, :-b], m[:, a:m.shape[1] - b + a], m[:, b:]
        code = (first * ALPHABET + mid) * ALPHABET + last
        yield code * (last > 0), DECAY ** (b + 1)


def _norms(m: np.ndarray) -> np.ndarray:
    total = np.full(len(m), 1e-12)
    for code, weight in _triples(m):
        total += weight * weight * (code > 0).sum(axis=1)
    return np.sqrt(total)


def term_scores(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """SVM margin of each word: the largest of its windows."""
    cores = [w.strip(_EDGES) or w for w in words]
    long = [i for i, c in enumerate(cores) if len(c) > WIDTH]
    flat, owner = cores, list(range(len(cores)))
    for i in long:
        flat[i], *more = _windows(cores[i])
        flat += more
        owner += [i] * len(more)
    out = _margins(flat, weights, bias)
    best = out[:len(words)].copy()
    if long:
        np.maximum.at(best, owner, out)
    return best


def _margins(flat: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """SVM margin of each window. Blocks hold windows of like length."""
    lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    order = np.argsort(lengths, kind="stable")
    out = np.empty(len(flat))
    weights = weights.astype(np.float32)
    for at in range(0, len(flat), 8_000):
        rows = order[at:at + 8_000]
        m = _matrix([flat[i] for i in rows], int(lengths[rows[-1]]))
        total, norm = np.zeros(len(rows)), np.full(len(rows), 1e-12)
        for code, weight in _triples(m):
            total += weight * weights[code].sum(axis=1)
            norm += weight * weight * (code > 0).sum(axis=1)
        out[rows] = total / np.sqrt(norm) + bias
    return out


class Landmarks:
    """Normalised kernel rows against fixed terms; only triples of the landmarks are looked up."""

    def __init__(self, marks: list[str]):
        m = _matrix(marks)
        norms = _norms(m)
        found = np.unique(np.concatenate([c.ravel() for c, _ in _triples(m)]))
        self.place = np.zeros(ALPHABET ** 3, dtype=np.int32)
        self.place[found] = np.arange(len(found))
        self.place[0] = 0  # code 0 sorts first when there is padding; its row stays empty
        if found[0] != 0:
            self.place[found] += 1
        self.rows = np.zeros((len(found) + 1, len(marks)), dtype=np.float32)
        for code, weight in _triples(m):
            for j in range(len(marks)):
                np.add.at(self.rows[:, j], self.place[code[j]], weight / norms[j])
        self.rows[0] = 0
        self.memo: dict[str, np.ndarray] = {}

    def kernel(self, terms: list[str]) -> np.ndarray:
        fresh = [t for t in dict.fromkeys(terms) if t not in self.memo]
        for at in range(0, len(fresh), 500):
            part = fresh[at:at + 500]
            m = _matrix(part)
            total = np.zeros((len(part), self.rows.shape[1]), dtype=np.float32)
            for code, weight in _triples(m):
                where = self.place[code]
                line, column = np.nonzero(where)
                if len(line):
                    values = self.rows[where[line, column]]
                    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                    total[line[starts]] += weight * np.add.reduceat(values, starts)
            total /= _norms(m)[:, None]
            self.memo.update(zip(part, total, strict=True))
        return np.stack([self.memo[t] for t in terms]).astype(np.float64)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3):
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = ridge * weight.sum() / x.shape[1] * np.eye(x.shape[1])
    reg[-1, -1] *= 1e-3
    active = np.ones(len(x), dtype=bool)
    for _ in range(30):
        xa = x[active] * weight[active, None]
        w = np.linalg.solve(xa.T @ x[active] + reg, xa.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], w[-1]


@dataclass
class Model:
    """``weights`` per triple, the SVM bias, and Platt's slope and offset."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    floor: float = -3.0

    def scores(self, margins: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(margins))
        z = np.clip(self.slope * np.maximum(margins, self.floor) + self.offset, -35, 35)
        return 1 / (1 + np.exp(-z))


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = p * (1 - p) + 1e-9
        hess = np.array([[(h * margins * margins).sum(), (h * margins).sum()],
                         [(h * margins).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - 0.7 * step[0], b - 0.7 * step[1]
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def train(
    bags, labels, landmarks: int = 240, rounds: int = 3, negatives: int = 12_000, hard: int = 3000
) -> Model:
    """Multi-instance SVM over an iterable of documents' term sets; every window of a term is one of the
    document's, kept once, as a number."""
    place: dict[str, int] = {}
    held, truth = [], []
    for bag, label in zip(bags, labels, strict=True):
        windows = dict.fromkeys(w for t in sorted(bag) for w in _windows(t))
        held.append(np.fromiter((place.setdefault(w, len(place)) for w in windows), np.int32))
        truth.append(int(label))
    truth = np.array(truth)
    if not len(truth) or truth.min() == truth.max():
        return Model()
    terms = list(place)
    del place

    def documents(y):
        found = [b for b, t in zip(held, truth, strict=True) if t == y]
        return np.bincount(np.concatenate(found), minlength=len(terms)), len(found)

    (c0, n0), (c1, n1) = documents(0), documents(1)
    if not c1.any():
        return Model()
    a, b = (c1 + 0.1) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
    often = c1 > 1 if (c1 > 1).any() else c1 > 0
    gains = np.where(often, a * np.log(a / b), -np.inf)
    ranked = np.lexsort((np.arange(len(terms)), -gains))[: int(often.sum())]
    # The first witnesses: each toxic document's best explained term.
    positive = [x for x, t in zip(held, truth, strict=True) if t and len(x)]
    witness = np.array([x[gains[x].argmax()] for x in positive])
    clean = np.array(sorted(np.flatnonzero(c0), key=lambda i: (crc32(terms[i].encode("utf-8", "replace")), terms[i])), dtype=int)
    marks = list(dict.fromkeys(terms[i] for i in [*ranked[: landmarks // 2], *clean[: landmarks // 2]]))
    landmark = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmark.kernel(marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    against = clean[:negatives]
    model = Model()
    for _ in range(rounds):
        chosen, times = np.unique(witness, return_counts=True)
        ids = np.r_[chosen, np.setdiff1d(against, chosen)]
        y = np.where(np.arange(len(ids)) < len(chosen), 1.0, -1.0)
        weight = np.ones(len(ids))
        weight[: len(chosen)] = np.minimum(times, 20)
        weight[: len(chosen)] *= max(1.0, (y < 0).sum() / weight[: len(chosen)].sum()) ** 0.5
        v, bias = _svm(landmark.kernel([terms[i] for i in ids]) @ root, y, weight)
        table = np.zeros(ALPHABET ** 3)
        m = _matrix(marks)
        scaled = (root @ v) / _norms(m)
        for code, w in _triples(m):
            np.add.at(table, code, w * scaled[:, None])
        table[0] = 0
        model = Model(table, float(bias))
        score = _margins(terms, table, model.bias)
        witness = np.array([x[score[x].argmax()] for x in positive])
        # Clean windows that come out highest join the negatives.
        against = np.union1d(against, clean[np.argsort(-score[clean], kind="stable")[:hard]])
    model.floor = float(score.min())
    margins = np.array([score[x].max() if len(x) else model.floor for x in held])
    model.slope, model.offset = _platt(margins, truth)
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, max_bags: int) -> DataFrame:
    """``text``, ``label`` of at most ``max_bags`` documents a class outside the held-out fold."""
    truth = (
        labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .filter(hash_bucket("doc_id", FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    )
    ids = documents.select("doc_id").join(truth, "doc_id").distinct()
    picked = [
        ids.filter(F.col("_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_bags)
        for y in (0, 1)
    ]
    # At most twice max_bags ids: the broadcast has a fixed bound.
    return documents.select("doc_id", "text").join(
        F.broadcast(picked[0].unionByName(picked[1])), "doc_id"
    ).select(text_of().alias("text"), "_label")


def fit(documents: DataFrame, labels: DataFrame, max_bags: int = 1000) -> Model:
    rows = labelled_sample(documents, labels, max_bags).collect()
    return train((text_terms(r.text) for r in rows), [r["_label"] for r in rows])


# Bytes of a generation of scored terms.
MEMO = 24 << 20


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Every row of ``documents`` with ``score`` and ``predicted``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    tag = f"{id(sent)}-{sent._jbroadcast.id() if sent._jbroadcast else 0}"

    def compute(batch):
        model = sent.value
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        if model.weights is None:
            return [np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int32)]
        memo = kept_in_task(tag, lambda: Recent(MEMO, entry=180, per_byte=2))
        margins = np.empty(len(texts))
        for at in range(0, len(texts), 64):
            memo.room()
            bags = [text_terms(t or "") for t in texts[at:at + 64]]
            fresh = list(set().union(*(memo.missing(b) for b in bags)))
            if fresh:
                memo.young.update(zip(fresh, term_scores(fresh, model.weights, model.bias).tolist(), strict=True))
            get = memo.young.__getitem__
            margins[at:at + 64] = [max(map(get, b), default=model.floor) for b in bags]
        p = model.scores(margins)
        return [p, (p >= 0.5).astype(np.int32)]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return with_columns(documents, fields, compute)
