"""Signature trees: nodes hold OR-combined token bitmaps and size ranges; a dual traversal prunes pairs of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

FANOUT = 8
SLICE = 8192


def bitmap_bits(n: int) -> int:
    """Width of a set's bitmap: a power of two of 4 to 8 bits per element, 64 to 65,536."""
    return min(max(64, 1 << (4 * max(n, 1) - 1).bit_length()), 1 << 16)


def bitmap(elements: np.ndarray) -> bytes:
    bits = bitmap_bits(len(elements))
    flags = np.zeros(bits, dtype=bool)
    flags[(elements >> np.uint64(8)) & np.uint64(bits - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Narrower bitmaps of the same sets: halves are OR-combined."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class Level(NamedTuple):
    maps: np.ndarray
    least: np.ndarray
    most: np.ndarray
    slack: np.ndarray
    low_class: np.ndarray
    high_class: np.ndarray


def build(maps: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> list[Level]:
    """Levels from the sets up to one root. Neighbours in the given order share nodes."""
    slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    levels = [Level(maps, sizes, sizes, slack, classes, classes)]
    while len(levels[-1].least) > 1:
        below, at = levels[-1], np.arange(0, len(levels[-1].least), FANOUT)
        levels.append(Level(
            np.bitwise_or.reduceat(below.maps, at, axis=0), np.minimum.reduceat(below.least, at), np.maximum.reduceat(below.most, at),
            np.maximum.reduceat(below.slack, at), np.minimum.reduceat(below.low_class, at), np.maximum.reduceat(below.high_class, at),
        ))
    return levels


def _may_link(a: Level, i: np.ndarray, b: Level, j: np.ndarray, sets: bool) -> np.ndarray:
    """Whether some pair below nodes i and j can reach a Jaccard similarity of 0.8 and is not in one class already."""
    same = (a.low_class[i] == a.high_class[i]) & (b.low_class[j] == b.high_class[j]) & (a.low_class[i] == b.low_class[j])
    near = (5 * a.most[i] >= 4 * b.least[j]) & (5 * b.most[j] >= 4 * a.least[i]) & ~same
    at = np.flatnonzero(near)
    for s in range(0, len(at), SLICE):
        k = at[s : s + SLICE]
        common = np.bitwise_count(a.maps[i[k]] & b.maps[j[k]]).sum(axis=1, dtype=np.int64)
        if sets:  # of each set, one element at least is missing for every bit that the other does not have
            overlap = np.minimum(a.slack[i[k]], b.slack[j[k]]) + common
        else:
            overlap = np.minimum(np.minimum(a.slack[i[k]], b.slack[j[k]]) + common, np.minimum(a.most[i[k]], b.most[j[k]]))
        near[k] = 9 * overlap >= 4 * (a.least[i[k]] + b.least[j[k]])
    return near


def _similarity(a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> np.ndarray:
    """The largest similarity that two sets can have by their bitmaps."""
    common = np.concatenate([np.bitwise_count(a.maps[i[s : s + SLICE]] & b.maps[j[s : s + SLICE]]).sum(axis=1, dtype=np.int64) for s in range(0, len(i), SLICE)])
    overlap = np.minimum(a.slack[i], b.slack[j]) + common
    return overlap / np.maximum(a.least[i] + b.least[j] - overlap, 1)


def dual_traversal(a: list[Level], b: list[Level], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the pairs of sets (of one tree if ``own``) that may have a similarity of 0.8, with the largest that they can have."""
    stack = [(len(a) - 1, len(b) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        p, q, i, j = stack.pop()
        if len(i) > SLICE:
            stack += [(p, q, i[s : s + SLICE], j[s : s + SLICE]) for s in range(0, len(i), SLICE)]
            continue
        keep = i <= j if own and p == q else np.ones(len(i), dtype=bool)
        if own and p == q == 0:
            keep = i < j
        keep[keep] = _may_link(a[p], i[keep], b[q], j[keep], p == q == 0)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if p == q == 0:
            yield i, j, _similarity(a[0], i, b[0], j)
            continue
        if p >= q:
            i, j = np.repeat(i * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(i)), np.repeat(j, FANOUT)
            p -= 1
            i, j = i[(k := i < len(a[p].least))], j[k]
        if q > p:
            i, j = np.repeat(i, FANOUT), np.repeat(j * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(j))
            q -= 1
            i, j = i[(k := j < len(b[q].least))], j[k]
        stack.append((p, q, i, j))


def candidate_slices(maps: list[bytes], sizes: np.ndarray, classes: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate pairs among sets and how similar they may be, in slices of at most ``SLICE``.

    There is one tree per width of bitmap; sides: 0 and 1 meet only each other, 2 meets itself. Sets of no element link with nothing.
    """
    widths = np.array([len(m) // 8 for m in maps])
    groups = {}
    for side in np.unique(sides):
        for w in np.unique(widths[sides == side]):
            at = np.flatnonzero((widths == w) & (sides == side))
            groups[side, w] = (at, np.frombuffer(b"".join(maps[k] for k in at), dtype=np.uint64).reshape(len(at), w))
    trees = {k: build(m, sizes[at], classes[at]) for k, (at, m) in groups.items()}

    for side, w in groups:
        for other, v in groups:
            together = (side == other == 2) or (side, other) in ((0, 1), (1, 0))
            if together and (v == 2 * w or v == w and side <= other):
                (at, _), (bt, wide) = groups[side, w], groups[other, v]
                right = trees[other, v] if v == w else build(fold(wide, w), sizes[bt], classes[bt])
                for i, j, similar in dual_traversal(trees[side, w], right, (side, w) == (other, v)):
                    yield at[i], bt[j], similar


def candidate_pairs(maps: list[bytes], sizes: np.ndarray, classes: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All slices at once."""
    empty = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(empty, *candidate_slices(maps, sizes, classes, sides), strict=True))
