"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut in blocks, the runs of text between block-level tags. Each has features of its ancestors
(tags, class and id words) and of its text (length, link share, punctuation, marks). The field has two
labels, main text or not; it is trained on labelled pages (``crfpages``) by the gradient of its
log-likelihood and decoded by Viterbi, so a block is judged together with its neighbours.

Text keeps its order; character references are decoded, white space inside a block becomes one space,
blocks are joined by a line end. Scripts, styles, markup and comments of the markup are no text.

Defined results: null, empty or text-free pages have the empty text; broken markup is read as browsers
mostly do (open paragraphs end at the next block, unknown end tags are ignored, text after the last tag
counts); repeated rows get equal texts; columns named like an output give way.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rolecall.llm import crfpages
from rolecall.llm.common import with_columns

TRAINING_PAGES, EPOCHS, STEP = 500, 6, 0.3

# Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCK - {"button", "label", "option", "optgroup", "select", "legend"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[©®™·|»›]")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(ancestors, text, characters inside links) of each block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    tags: list[str] = []
    marks: list[str] = []  # one for each open tag: the tag, then its class and id words
    held: list[str] = []
    path: tuple[str, ...] = ()
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((path, text, links))
            held.clear()
        links = 0

    def drop(to: int) -> None:
        nonlocal path
        del tags[to:], marks[to:]
        path = tuple(marks)

    n = len(page)
    while at < n:
        start = page.find("<", at)
        m = None
        if start >= 0:
            m = _TAG.match(page, start)
            if m is None:  # a lone sign is text
                held.append(page[at:start + 1])
                at = start + 1
                continue
        stop = start if m else n
        if stop > at:
            piece = page[at:stop]
            held.append(piece)
            if in_link:
                links += len(piece)
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = 0
            elif name in BLOCK and name in tags:
                flush()
                drop(len(tags) - 1 - tags[::-1].index(name))
            elif name == "p":
                flush()
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            flush()
            at = end.end() if end else n
        elif name == "a":
            in_link = 1
        elif name == "br":
            held.append(" ")
        elif name in BLOCK:
            flush()
            if "p" in tags and name in ENDS_P:
                drop(len(tags) - 1 - tags[::-1].index("p"))
            if tags and tags[-1] == name and name in ("li", "option", "tr", "td", "dt", "dd"):
                drop(len(tags) - 1)
            if name not in VOID:
                tags.append(name)
                found = _NAMES.findall(m[3]) if "=" in m[3] else ()
                marks.append(" ".join([name, *(x.strip("\"'") for x in found)]))
                path = tuple(marks)
    flush()
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    """Of the ancestors: each tag, each class or id word and its beginning, the leaf and its parent."""
    out = set()
    for mark in path:
        tag, *names = mark.split()
        out.add(f"in:{tag}")
        for name in names:
            for word in _NAME_WORD.findall(name):
                word = word.lower()
                out.add(f"name:{word}")
                out.add(f"stem:{word[:5]}")
    if path:
        out.add(f"leaf:{path[-1].split()[0]}")
        sections = [m.split()[0] for m in path if m.split()[0] in
                    ("article", "main", "nav", "aside", "header", "footer", "form", "section", "ul", "table")]
        out.add(f"near:{sections[-1] if sections else ''}")
        out.add(f"pair:{sections[-1] if sections else ''}:{path[-1].split()[0]}")
    return sorted(out)


def text_features(text: str, links: int) -> list[str]:
    n = len(text)
    share = min(links / n, 1)
    out = [
        f"length:{min(n.bit_length(), 10)}",
        f"links:{0 if links == 0 else 1 + int(share * 3)}",
        f"stop:{text[-1] in '.!?:'}",
        f"commas:{min(text.count(',') + text.count('. '), 3)}",
    ]
    if _MARKS.search(text):
        out.append("marks")
    return out


class Field:
    """Label weights per feature, and transitions apart for equal and different ancestors."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves = np.zeros((2, 2, 2))  # same ancestors as the block before, label before, label
        self.memo: dict[tuple[str, ...], float] = {}

    def scores(self, page) -> tuple[list[float], list[int]]:
        """Score of main text over other, and whether the ancestors are those of the block before."""
        w, memo, out, same = self.weights.get, self.memo, [], []
        before = None
        if len(memo) > 50_000:
            memo.clear()
        for path, text, links in page:
            s = memo.get(path)
            if s is None:
                s = memo[path] = sum(w(f, 0.0) for f in path_features(path))
            out.append(s + sum(w(f, 0.0) for f in text_features(text, links)))
            same.append(int(path == before))
            before = path
        return out, same

    def decode(self, page) -> list[int]:
        """The best labels, by Viterbi."""
        if not page:
            return []
        scores, same = self.scores(page)
        moves = self.moves.tolist()
        a, b, back = 0.0, scores[0], []
        for s, k in zip(scores[1:], same[1:], strict=True):
            m = moves[k]
            stay, come = a + m[0][0], b + m[1][0]
            leave, keep = a + m[0][1], b + m[1][1]
            back.append((int(come > stay), int(keep >= leave)))
            a, b = max(stay, come), s + max(leave, keep)
        label = int(b >= a)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]

    def learn(self, page, labels: list[int], step: float, squares: dict) -> None:
        """One step up the gradient of the log-likelihood, by forward and backward sums."""
        self.memo.clear()
        scores, same = self.scores(page)
        n = len(page)
        node = np.stack([np.zeros(n), np.array(scores)], axis=1)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = node[0]
        for i in range(1, n):
            forward[i] = node[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.moves[same[i]], axis=0)
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.moves[same[i + 1]] + node[i + 1] + backward[i + 1], axis=1)
        z = np.logaddexp.reduce(forward[-1])
        chance = np.exp(forward[:, 1] + backward[:, 1] - z)
        gradient: dict[str, float] = {}
        for i, (path, text, links) in enumerate(page):
            for f in path_features(path) + text_features(text, links):
                gradient[f] = gradient.get(f, 0.0) + labels[i] - chance[i]
        for f, g in gradient.items():
            g -= 1e-3 * self.weights.get(f, 0.0)
            squares[f] = squares.get(f, 1e-6) + g * g
            self.weights[f] = self.weights.get(f, 0.0) + step * g / squares[f] ** 0.5
        change = np.zeros_like(self.moves)
        for i in range(1, n):
            pair = forward[i - 1][:, None] + self.moves[same[i]] + node[i] + backward[i] - z
            change[same[i]] -= np.exp(pair)
            change[same[i], labels[i - 1], labels[i]] += 1
        self.moves += step * 0.05 * change


def train(pages: list[tuple[str, list[int]]], epochs: int = EPOCHS) -> Field:
    field, squares = Field(), {}
    cut = [(blocks(p), y) for p, y in pages]
    for epoch in range(epochs):
        for page, labels in cut:
            if page and len(page) == len(labels):
                field.learn(page, labels, STEP / (1 + epoch / 2), squares)
    field.memo.clear()
    return field


def labelled_pages(n: int = TRAINING_PAGES, first: int = 0) -> list[tuple[str, list[int]]]:
    return [crfpages.page(s) for s in range(first, first + n)]


def main_text(field: Field, page: str) -> str:
    cut = blocks(page)
    return "\n".join(b[1] for b, y in zip(cut, field.decode(cut), strict=True) if y)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """Every row with ``text`` and ``n_chars`` of its whole ``html``."""
    sent = pages.sparkSession.sparkContext.broadcast(field)

    def compute(batch):
        found = [
            main_text(sent.value, p or "")
            for p in batch.column(batch.schema.get_field_index("html")).to_pylist()
        ]
        return [found, [len(t) for t in found]]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return with_columns(pages, fields, compute)
