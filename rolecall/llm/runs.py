"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with a smallest period q that repeats at least ``exponent`` times, has at
least ``least`` words, and that no neighbouring word extends. Texts are taken in blocks of BLOCK words
(a longer text is a block of its own), whose suffixes are sorted together:

1. Suffixes are ranked by prefixes of 1, 2, 4, ... words; only groups that are not yet single are
   sorted again. Words of different texts never count as equal. Every round's ranks are kept: two
   suffixes share a prefix of 2**k words exactly if their ranks of round k are equal, so common
   prefixes and suffixes of any length are found in as many steps as there are rounds.
2. Neighbours in the suffix array give the LCP table, and the nearest smaller values left and right of
   an entry the LCP interval to which it belongs. No tree is built.
3. In an interval of depth d, every suffix i outside the largest child is tested: if ISA[i + d] or
   ISA[i - d] lies in the interval but in another child, a square of period d starts at i or i - d
   and cannot move on to the right (it branches).
4. A branching square is rotated to the left as far as it goes; that is the run. Squares of a period
   that is a multiple give the same run again, which keeps its smallest period.

Only intervals with ``exponent`` suffixes or more can hold a run's period, and only depths of at most
1/exponent of the text, so no others are tested.

Null and empty word lists have no runs and collapse to the empty text. Repeated rows get the same result
each. A text of any length is one row of one task: its memory is about 100 bytes a word. Columns named
``runs`` or ``collapsed`` give way to the new ones; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.llm.common import with_columns

LEAST, EXPONENT = 6, 4
# Words whose suffixes are sorted together.
BLOCK = 1 << 18
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def words(text: str = "text") -> Column:
    """The words of a text: what stands between ASCII blanks."""
    found = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.array_remove(found, "")


def _refine(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by prefixes of 1, 2, 4, ... keys); a rank is its group's first slot.

    Keys that stand alone end the common prefixes, so the sequence must end in one."""
    n = len(keys)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    sorted_ = keys[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    slots = np.arange(n, dtype=np.int32)
    first = np.maximum.accumulate(np.where(fresh, slots, 0)).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = first
    kept, step = [rank], 1
    last = np.append(fresh[1:], True)
    active = slots[~(fresh & last)]
    while len(active):
        suffix = order[active]
        key = rank[suffix].astype(np.int64) * n + rank[suffix + step]
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[active] = suffix
        fresh = np.empty(len(key), bool)
        fresh[0] = True
        fresh[1:] = key[1:] != key[:-1]
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        rank = rank.copy()
        rank[suffix] = active[at]
        kept.append(rank)
        last = np.append(fresh[1:], True)
        active = active[~(fresh & last)]
        step *= 2
    return order, kept


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a and b, pair by pair."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        found += np.where(ranks[k][a + found] == ranks[k][b + found], 1 << k, 0)
    return found


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) slot of the LCP interval of each entry ``at`` of depth 2 or more."""
    deep = lcp >= 2
    # Stretches of deep entries, each closed by an entry below them.
    taken = np.flatnonzero(deep | np.append(False, deep[:-1]))
    value = np.concatenate([[0], np.where(deep[taken], lcp[taken], 0), [0]])
    place = np.concatenate([[-1], taken, [len(lcp)]])
    start = np.searchsorted(taken, at) + 1
    depth = lcp[at]
    lows = [value]
    while (1 << len(lows)) < len(value):
        half = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
    left, right = start.copy(), start.copy()
    for k in range(len(lows) - 1, -1, -1):
        far = left - (1 << k)
        ok = far >= 0
        ok[ok] = lows[k][far[ok]] >= depth[ok]
        left[ok] = far[ok]
        ok = right + 1 + (1 << k) <= len(value)
        ok[ok] = lows[k][right[ok] + 1] >= depth[ok]
        right[ok] += 1 << k
    return place[left] - 1, place[right]


def _intervals(order, ranks, lcp, size_of, exponent):
    """(entry, depth, first, last) of the entries whose interval may hold a run's period."""
    reach = exponent - 1
    low = lcp.copy()
    for k in range(1, reach):
        low[:-k] = np.minimum(low[:-k], lcp[k:])
    if reach > 1:
        low[-(reach - 1):] = 0
    best = low.copy()
    for k in range(1, reach):
        best[k:] = np.maximum(best[k:], low[:-k])
    fits = (lcp > 0) & (best >= lcp) & (lcp * exponent <= size_of[order])
    at = np.flatnonzero(fits)
    depth = lcp[at]
    first, last = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    flat = depth == 1
    heads = ranks[0][order]
    first[flat] = heads[at[flat]]
    last[flat] = np.searchsorted(heads, heads[at[flat]], side="right") - 1
    if not flat.all():
        first[~flat], last[~flat] = _bounds(lcp, at[~flat])
    return at, depth, first, last


def _squares(order, inverse, at, depth, first, last):
    """(start, period) of the branching squares: smaller children tested against their interval."""
    by = np.lexsort((at, depth, first))
    at, depth, first, last = at[by], depth[by], first[by], last[by]
    opens = np.append(True, (first[1:] != first[:-1]) | (depth[1:] != depth[:-1]))
    closes = np.append(opens[1:], True)
    group = np.cumsum(opens) - 1
    # Children end before an entry of the interval's depth; the last one ends with the interval.
    begin = np.where(opens, first, np.append(0, at[:-1]))
    child_first = np.concatenate([begin, at[closes]])
    child_last = np.concatenate([at - 1, last[closes]])
    of = np.concatenate([group, group[closes]])
    size = child_last - child_first + 1
    by = np.lexsort((-size, of))
    largest = by[np.append(True, of[by][1:] != of[by][:-1])]
    small = np.ones(len(of), bool)
    small[largest] = False
    child_first, child_last, of, size = child_first[small], child_last[small], of[small], size[small]
    low, high, d = first[opens][of], last[opens][of], depth[opens][of]
    each = np.repeat(np.arange(len(of)), size)
    slot = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + child_first[each]
    suffix = order[slot].astype(np.int64)
    starts, periods = [], []
    for sign in (1, -1):
        other = suffix + sign * d[each]
        spot = inverse[np.maximum(other, 0)]
        hit = (other >= 0) & (spot >= low[each]) & (spot <= high[each])
        hit &= (spot < child_first[each]) | (spot > child_last[each])
        starts.append(suffix[hit] if sign > 0 else other[hit])
        periods.append(d[each][hit])
    return np.concatenate(starts), np.concatenate(periods)


def _block_runs(codes: np.ndarray, sizes: np.ndarray, least: int, exponent: int):
    """(text, start, length, period) of every run of texts that lie one after another."""
    total, texts = len(codes), len(sizes)
    if not total:
        return [np.zeros(0, np.int64)] * 4
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(texts), sizes)
    # Every text is followed by a key that stands alone.
    keys = np.empty(total + texts, np.int64)
    place = np.arange(total) + text
    width = int(codes.max()) + 1
    keys[place] = text * np.int64(width) + codes
    keys[ends + np.arange(texts)] = texts * np.int64(width) + np.arange(texts)
    owner = np.repeat(np.arange(texts), sizes + 1)
    order, ranks = _refine(keys)
    nothing = [np.zeros(0, np.int64)] * 4
    if len(ranks) == 1:
        return nothing
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.arange(len(order), dtype=np.int32)
    same = np.flatnonzero(np.append(False, ranks[0][order][1:] == ranks[0][order][:-1]))
    lcp = np.zeros(len(order), np.int64)
    lcp[same] = _common(ranks[:-1], order[same - 1].astype(np.int64), order[same].astype(np.int64))
    found = _intervals(order, ranks, lcp, sizes[owner], exponent)
    if not len(found[0]):
        return nothing
    start, period = _squares(order, inverse, *found)
    pairs = np.unique(np.stack([start, period]), axis=1)
    start, period = pairs[0], pairs[1]
    # Rotate to the left while the word before equals the one a period on.
    moved = np.zeros(len(start), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        far = start - moved - (1 << k)
        ok = far >= 0
        ok[ok] = ranks[k][far[ok]] == ranks[k][far[ok] + period[ok]]
        moved[ok] += 1 << k
    start, length = start - moved, moved + 2 * period
    long = (length >= least) & (length >= exponent * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    keep = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[keep], length[keep], period[keep]
    which = owner[start]
    start = start - (ends - sizes + np.arange(texts))[which]
    by = np.lexsort((period, start, which))
    return which[by], start[by], length[by], period[by]


def _batch_runs(codes: np.ndarray, offsets: np.ndarray, least: int, exponent: int):
    """The runs of all texts of a batch, block by block."""
    sizes, found, row = np.diff(offsets), [], 0
    while row < len(sizes):
        # As many texts as fit, one at least.
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        end = min(max(end, row + 1), len(sizes))
        part = codes[offsets[row]: offsets[end]]
        which, *rest = _block_runs(part, sizes[row:end], least, exponent)
        found.append((which + row, *rest))
        row = end
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def with_runs(
    df: DataFrame, column: str = "words", least: int = LEAST, exponent: int = EXPONENT
) -> DataFrame:
    """``df`` with ``runs``, by start and period, and ``collapsed``: the words joined by one space,
    without those that repeat a run's first period."""
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")

    def compute(batch: pa.RecordBatch) -> list:
        lists = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = lists.flatten()
        codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        which, start, length, period = _batch_runs(codes, offsets, least, exponent)
        # +1 where a run's repeats begin, -1 where they end.
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, offsets[which] + start + period, 1)
        np.add.at(change, offsets[which] + start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(kept)])[offsets]
        text = pc.binary_join(
            pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept))), " "
        )
        ends = np.searchsorted(which, np.arange(len(size) + 1))
        rows = pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (start, length, period)], names=RUN.names
        )
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), text]

    fields = [T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    return with_columns(df, fields, compute)


def repeated_tail(words_: Column, h: Column) -> Column:
    """The words with, where h % 10 = 0, all from word a on replaced by a repeat of the p words there."""
    n = F.size(words_)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words_, a + 1, p), times))
    new = F.slice(F.concat(F.slice(words_, F.lit(1), a), tail), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), new).otherwise(words_)


def longest(runs: str = "runs") -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    ordered = F.transform(
        runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))
    )
    best = F.array_min(ordered)
    return F.when(
        F.size(runs) > 0,
        F.struct(best["b"].alias("start"), (-best["a"]).alias("length"), best["c"].alias("period")),
    )
