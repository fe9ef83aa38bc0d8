"""Periodic runs of words: stretches in which the same words come again and again at one distance.

A run is a stretch of consecutive words with least period q, of at least ``min_words`` words and ``min_periods`` periods,
that no neighbouring word extends. Runs come out of an enhanced suffix array over the words (branching-tandem test):

1. Suffix array by prefix doubling; the ranks of every doubling stay, so that two substrings are compared in log steps.
   They give the LCP array, and the nearest smaller LCP values on both sides give the LCP intervals; there are no nodes.
2. For each interval of depth d, the suffixes i of all its children but the largest look up ISA[i + d] and ISA[i - d]:
   where that lies in the interval and the next words differ, a square of period d ends there. The smaller children of
   all intervals have n log n suffixes at most.
3. Squares are rotated to the left as far as the words repeat, which gives the whole run; of runs over the same words the
   one with the least period stays.

A word that occurs fewer than ``min_periods`` times can't be in a run, so texts are first cut at such words, and the
pieces again, until every word of a piece occurs so often in it. No run is lost or changed by that.

A text is handled where it is read, so nothing is shuffled; a task holds one batch of texts. Defined results: null and
empty texts have no words and no runs; repeated rows, null ids and other columns (which are left out) change nothing; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow import small_batches
from .shingles import BLANK, text_bytes

MIN_WORDS, MIN_PERIODS = 6, 4
#: Suffixes of smaller children that are tested at one time.
CHUNK = 1 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, for each text where its words begin, and the end); words are the stretches of [^\\x20\\x09-\\x0D]."""
    raw, offsets = text_bytes(texts)
    solid = ~BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(solid, dtype=np.int64)  # bytes of words up to and with each byte
    at = np.concatenate([kept[starts] - 1, kept[-1:]]) if len(starts) else np.zeros(1, dtype=np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[solid])))
    return words, np.searchsorted(starts, offsets)


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0, equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    return out


def _pieces(codes: np.ndarray, text: np.ndarray, least: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, piece of each): what is left when words that occur fewer than ``least`` times in their piece cut it."""
    at, piece = np.arange(len(codes)), text
    while len(at):
        _, inverse, counts = np.unique(piece * (codes.max() + 1) + codes[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= least
        at, piece = at[often], piece[often]
        if not len(at):
            break
        new = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])]))
        long = np.bincount(new)[new] >= shortest
        done = often.all() and long.all() and new[-1] == len(np.unique(piece)) - 1
        at, piece = at[long], new[long]
        if done:
            break
    return at, piece


class SuffixRanks:
    """Suffix array of pieces of codes, with the ranks of all doublings; substrings are compared within a piece."""

    def __init__(self, codes: np.ndarray, piece: np.ndarray):
        n = len(codes)
        self.codes = codes
        self.end = np.searchsorted(piece, piece, side="right")
        self.begin = np.searchsorted(piece, piece, side="left")
        rank, width, place = _dense(piece * (codes.max() + 1) + codes), 1, np.arange(n)
        self.levels = [rank.astype(np.int32)]
        while rank.max() < n - 1:
            other = place + width
            second = np.where(other < self.end, rank[np.minimum(other, n - 1)] + 1, 0)  # the end of a piece sorts first
            rank, width = _dense(rank * (n + 1) + second), 2 * width
            self.levels.append(rank.astype(np.int32))
        self.isa = rank
        self.sa = np.empty(n, dtype=np.int64)
        self.sa[rank] = place

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and at b have in common."""
        n, a, b, out = len(self.codes), a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, inside = self.levels[k], (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            # Equal ranks of places that have fewer words left than the width are one and the same place.
            step = np.where(same, 1 << k, 0)
            out, a, b = out + step, a + step, b + step
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that end before a and before b and are the same; a < b lie in one piece."""
        a, b, first = a.copy(), b.copy(), self.begin[a]
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << k), b - (1 << k)
            same = (x >= first) & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])
            a, b = np.where(same, x, a), np.where(same, y, b)
        return start - a


def _smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the nearest places before and after it with a smaller value; -1 and n where there is none."""
    n, tables = len(values), [values]
    while 2 ** len(tables) <= n:
        last, half = tables[-1], 2 ** (len(tables) - 1)
        tables.append(np.minimum(last[:-half], last[half:]))
    after, before = np.arange(n) + 1, np.arange(n) - 1  # tables[k][i] is the least of values[i : i + 2**k]
    for k in range(len(tables) - 1, -1, -1):
        width, table = 1 << k, tables[k]
        fits = after + width <= n
        after = np.where(fits & (table[np.minimum(after, len(table) - 1)] >= values), after + width, after)
        low = before - width + 1
        before = np.where((low >= 0) & (table[np.clip(low, 0, len(table) - 1)] >= values), before - width, before)
    return before, after


def _squares(index: SuffixRanks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of the branching squares, in chunks."""
    n, sa, isa, codes = len(index.codes), index.sa, index.isa, index.codes
    lcp = np.concatenate([[0], index.common_after(sa[:-1], sa[1:])])  # of the suffix at each place and the one before it
    left, right = _smaller_neighbours(lcp)
    splits = np.flatnonzero(lcp > 0)
    # An interval is its nearest smaller places; the places within it that have its depth split its children.
    splits = splits[np.lexsort((splits, right[splits], left[splits]))]
    low, high = left[splits], right[splits]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(splits)]
    interval = np.cumsum(new) - 1
    heads = splits[new]
    # Children begin at the interval's left end and at each split.
    owner = np.concatenate([np.arange(len(heads)), interval])
    begin = np.concatenate([left[heads], splits])
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])[: len(owner)]
    end = np.where(last, right[heads][owner], np.concatenate([begin[1:], [0]])[: len(owner)])
    size = end - begin
    largest = np.zeros(len(owner), dtype=bool)
    by_size = np.lexsort((-size, owner))
    largest[by_size[np.concatenate([[True], owner[by_size][1:] != owner[by_size][:-1]])[: len(owner)]]] = True
    owner, begin, size = owner[~largest], begin[~largest], size[~largest]
    total = np.cumsum(size)
    for a, b in _chunks(total):
        many = size[a:b]
        # A child's share of a chunk may be large, but all shares of a chunk of several children are bounded by CHUNK.
        place = np.repeat(begin[a:b], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of = np.repeat(heads[owner[a:b]], many)
        i, d, lo, hi = sa[place], lcp[of], left[of], right[of]
        stop = index.end[i]
        for x in (i, i - d):  # the square that begins at x has its second half at x + d
            y = x + d
            inside = (x >= index.begin[i]) & (y < stop)
            other = isa[np.clip(np.where(x == i, y, x), 0, n - 1)]
            inside &= (lo <= other) & (other < hi)
            ends = (y + d >= stop) | (codes[np.clip(x + d, 0, n - 1)] != codes[np.clip(y + d, 0, n - 1)])
            yield x[inside & ends & (y + d <= stop)], d[inside & ends & (y + d <= stop)]


def _chunks(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of children that have about CHUNK suffixes together."""
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, side="right")))
        yield a, b
        a = b


def find_runs(codes: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; codes of all words, and the text that each is in."""
    none = np.zeros(0, dtype=np.int64)
    at, piece = _pieces(codes, text, min_periods, max(min_words, min_periods)) if len(codes) else (none, none)
    if not len(at):
        return none, none, none
    index = SuffixRanks(codes[at], piece)
    found = [np.stack(x) for x in _squares(index)]
    start, period = np.concatenate(found, axis=1) if found else (none, none)
    stop = start + 2 * period
    start = start - index.common_before(start, start + period)
    keep = stop - start >= np.maximum(min_words, min_periods * period)
    runs = np.unique(np.stack([start[keep], stop[keep], period[keep]], axis=1), axis=0)
    first = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])[: len(runs)]  # the least period of each stretch
    start, stop, period = runs[first].T
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    return at[start], stop - start, period


def _report(words: pa.Array, first: np.ndarray, min_words: int, min_periods: int) -> tuple[list[list[dict]], pa.Array]:
    """The runs of each text, and the words left when each run keeps only its first period."""
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, length, period = find_runs(codes, text, min_words, min_periods)
    runs: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for t, s, n, q in zip(text[start].tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append({"start": s - int(first[t]), "length": n, "period": q})
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    kept = np.cumsum(covered)[:-1] == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[first]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.filter(pa.array(kept)))
    return runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per row of ``docs``: id, runs (by start, then period), runs_sha256 of their lines, and the collapsed text."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = split_words(batch.column(1))
            runs, collapsed = _report(words, first, min_words, min_periods)
            lines = ["".join(f"{r['start']},{r['length']},{r['period']}\n" for r in x) for x in runs]
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            hashes = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), hashes, collapsed.cast(pa.string())], ["id", "runs", "runs_sha256", "collapsed"])

    rows = docs.select(docs[id_col], docs[text])
    out = rows.mapInArrow(build, f"id {id_type}, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string")
    return out.withColumnRenamed("id", id_col)
