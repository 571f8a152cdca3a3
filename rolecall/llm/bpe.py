"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a hash of the last eight bytes meets a fixed pattern, so equal passages
are cut alike wherever they stand. Each task keeps a memo of chunks, bounded by bytes and ended with the task: a chunk met again, in
whichever document, is not encoded again. Inside a new chunk the white-space pieces are the unit of
reuse, with a memo of their own.

A cut may fall inside a word, so only what lies between a chunk's first and last white space is
taken from its encoding. The join is repaired: the loose end before the cut and the loose start after
it are put together and encoded anew, and the repair widens over further chunks until it stands
between white space on both sides. There the tokenizer's pre-splitting starts afresh, so the
separate and the whole encoding agree exactly; tests compare with the library on whole texts. The
tokenizer's decoder decodes each piece's ids once a memo, since it puts a space between tokens; for a
file whose decoder does not, whole texts are decoded. A file that does not part words at blanks is refused.

Defined results: null is the empty text, with no tokens and the digest of nothing; repeated rows are
encoded alike; columns named like an output give way. The tokenizer file is a parameter and must lie
at the same path on every executor. Nothing is trained, shuffled or sent to the driver.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rolecall.llm.common import Recent, kept_in_task, with_columns

CHUNK_BITS = 9  # chunks of 512 bytes on average
WORDS, CHUNKS = 32 << 20, 12 << 20  # bytes of a memo generation
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[ \t\n\r]+")

OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def chunks(data: bytes, bits: int = CHUNK_BITS) -> list[bytes]:
    """The content-defined chunks of a UTF-8 text; no cut falls inside a character."""
    n = len(data)
    if n < 16:
        return [data] if data else []
    windows = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    hits = np.flatnonzero((windows * _MIX) >> np.uint64(64 - bits) == 0) + 8
    starts = [0]
    for p in hits.tolist():
        if p < n and data[p] & 0xC0 != 0x80:
            starts.append(p)
    return [data[a:b] for a, b in zip(starts, starts[1:] + [n], strict=True)]


def _pieces(data: bytes) -> list[bytes]:
    if b"\x0b" in data or b"\x0c" in data:
        return [p for p in _BLANK.split(data) if p]
    return data.split()


class Coder:
    """Encodes with one tokenizer file; keeps bounded memos between texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.words, self.chunks = Recent(WORDS), Recent(CHUNKS, entry=600)
        if self._ids("ab cd\nab") != [*self._ids("ab"), *self._ids("cd"), *self._ids("ab")]:
            raise ValueError(f"{path} does not encode words between blanks by themselves")
        # Words of ASCII letters may share the encoding of their lower case, and signs stand apart.
        self.plain = all(
            self._ids(a) == self._ids(b) + self._ids(c)
            for a, b, c in (("Ab", "ab", ""), ("ab.", "ab", "."), ("aB,", "ab", ","))
        )
        # Whether the decoder puts a space between pieces, so that they can be decoded one by one.
        probe = [self._ids("ab. cd"), self._ids("ab."), self._ids("cd")]
        whole, first, second = self.decode(probe)
        self.joins = whole == f"{first} {second}"
        self.signs = dict(zip(".,", self._entries([self._ids("."), self._ids(",")]), strict=True))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode new pieces. One of letters up to U+00FF only, but for a last full stop or comma, shares
        the encoding of its letters, in lower case if ASCII. Other letters may join with what follows them
        when they are brought to their normal form, so their pieces are encoded whole."""
        whole, made, cores = [], [], {}
        for piece in fresh:
            text = piece.decode()
            core, tail = (text[:-1], text[-1]) if text[-1] in ".," else (text, "")
            if not (self.plain and core.isalpha() and max(core) <= "\xff"):
                whole.append(piece)
                continue
            key = (core.lower() if core.isascii() else core).encode()
            made.append((piece, key, tail))
            cores[key] = None
        memo = self.words
        self._letters(memo.missing(cores))
        young = memo.young
        for piece, key, tail in made:
            n, ids, text = young[key]
            if tail:
                more = self.signs[tail]
                young[piece] = (n + more[0], f"{ids} {more[1]}", f"{text} {more[2]}")
            elif piece != key:
                young[piece] = young[key]
        if whole:
            found = self.tokenizer.encode_batch_fast(
                [w.decode() for w in whole], add_special_tokens=False
            )
            young.update(zip(whole, self._entries([e.ids for e in found]), strict=True))

    def _entries(self, ids: list[list[int]]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each list of ids."""
        texts = self.decode(ids) if self.joins else [""] * len(ids)
        return [(len(i), " ".join(map(str, i)), t) for i, t in zip(ids, texts, strict=True)]

    def _letters(self, cores: list[bytes]) -> None:
        """Encode words of letters, many in one call; a word's last token closes it."""
        young, ends = self.words.young, self.ends
        for at in range(0, len(cores), 1000):
            part = cores[at:at + 1000]
            ids = self.tokenizer.encode_batch_fast(
                [b" ".join(part).decode()], add_special_tokens=False
            )[0].ids
            cut = [i + 1 for i, t in enumerate(ids) if t in ends]
            if len(cut) == len(part) and cut[-1] == len(ids):
                pieces = [ids[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
                young.update(zip(part, self._entries(pieces), strict=True))
            else:  # a vocabulary without word ends
                each = [self._ids(core.decode()) for core in part]
                young.update(zip(part, self._entries(each), strict=True))

    def _chunk(self, chunk: bytes):
        """(loose start, pieces between, loose end); without white space all is loose."""
        parts = _BLANK.split(chunk)
        if len(parts) == 1:
            return None
        return parts[0], _pieces(b" ".join(parts[1:-1])), parts[-1]

    def encode(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text if ``joins``) of each text."""
        self.words.room()
        self.chunks.room()
        plans, wanted, opened = [], set(), {}
        for data in texts:
            plan, loose = [], b""
            for chunk in chunks(data):
                if self.chunks.missing((chunk,)) and chunk not in opened:
                    opened[chunk] = self._chunk(chunk)
                    if opened[chunk]:
                        wanted.update(opened[chunk][1])
                start = opened[chunk] if chunk in opened else self.chunks.young[chunk]
                if start is None:
                    loose += chunk  # the repair goes on through this chunk
                    continue
                plan += [(False, loose + start[0]), (True, chunk)]
                loose = start[-1]
            plan.append((False, loose))
            plan = [x for x in plan if x[1]]
            wanted.update(x for inside, x in plan if not inside)
            plans.append(plan)
        fresh = self.words.missing(wanted)
        if fresh:
            self._learn(fresh)
        word = self.words.young.__getitem__
        for chunk, entry in opened.items():
            if entry is None:
                self.chunks.young[chunk] = None
                continue
            found = [x for x in map(word, entry[1]) if x[0]]
            self.chunks.young[chunk] = (
                entry[0],
                (sum([x[0] for x in found]), " ".join([x[1] for x in found]),
                 " ".join([x[2] for x in found])),
                entry[2],
            )
        out = []
        for plan in plans:
            found = [self.chunks.young[x][1] if inside else word(x) for inside, x in plan]
            found = [x for x in found if x[0]]
            out.append((
                sum([x[0] for x in found]), " ".join([x[1] for x in found]),
                " ".join([x[2] for x in found]),
            ))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(
    documents: DataFrame,
    path: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """Every row with the wanted ``outputs`` (see OUTPUTS) of its whole ``text``."""

    decoding = bool({"decoded", "decoded_sha256"} & set(outputs))

    def compute(batch):
        import pyarrow as pa

        coder = kept_in_task(path, lambda: Coder(path))
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        texts = [t or b"" for t in column.to_pylist()]
        done = []
        at = 0
        while at < len(texts):  # about a megabyte at a time
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                size += len(texts[to])
                to += 1
            found = coder.encode(texts[at:to])
            listed = "ids" in outputs or decoding and not coder.joins
            numbers = [[int(i) for i in ids.split()] if listed else None for _, ids, _ in found]
            decoded = [text for *_, text in found]
            if decoding and not coder.joins:
                decoded = coder.decode(numbers)
            for (n, ids, _), own, text in zip(found, numbers, decoded, strict=True):
                done.append((
                    n,
                    own if "ids" in outputs else None,
                    _digest(ids) if "ids_sha256" in outputs else None,
                    text if "decoded" in outputs else None,
                    _digest(text) if "decoded_sha256" in outputs else None,
                ))
            at = to
        columns = dict(zip(OUTPUTS, zip(*done, strict=True), strict=True))
        return [list(columns[o]) for o in outputs]

    return with_columns(documents, [T.StructField(o, OUTPUTS[o]) for o in outputs], compute)
