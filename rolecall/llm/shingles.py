"""64-bit hashes of word shingles, whole texts at a time in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(21).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: list = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int):
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words, the runs without space, tab or line end."""
    solid = ~_BLANKS[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word, A-Z lower-cased, in text order."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    data = data.translate(_LOWER)
    starts, ends = word_bounds(data)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, dtype=np.uint8)] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence where it is shorter."""
    n = min(size, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total += words[i:len(words) - n + 1 + i] * _PLACES[i]
    return mixed(total)


def shingle_set(data: bytes | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(word_hashes(data or b""), size))


def set_key(values: np.ndarray) -> int:
    """One signed 64-bit key of a set of hashes."""
    if not len(values):
        return 0
    total = np.add.reduce(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    both = mixed(np.array([total ^ np.uint64(len(values))], dtype=np.uint64))
    return int(both.view(np.int64)[0])
