"""Content-defined anchors: of every ``length`` bytes of a text, one k-gram that depends on these bytes alone."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .shingles import mix

GRAM = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(7, 263, dtype=np.uint64))
#: Bytes that are worked on at a time, so that the arrays stay in the cache; longer texts are taken in pieces that overlap.
PIECE = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


@lru_cache
def _up_and_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


def piece_for(length: int) -> int:
    """Bytes to work on at a time for strings of that length."""
    return max(PIECE, 1 << (8 * length - 1).bit_length())


#: Values of pairs of neighbouring bytes: sums over single letters would meet in strings of a regular structure.
_PAIR = {salt: mix(mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(salt << 20))) for salt in (11, 77)}


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes from each position on, for a piece of text."""
    up, down = _up_and_down(max(PIECE, len(raw)))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(raw) - k + 1])


def _sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Keys of the least entry of each window of w; keys are distinct."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def _anchors_of_piece(raw: np.ndarray, inside: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes = gram_hashes(raw, GRAM)
    low = np.uint64((1 << 20) - 1)
    least = _sliding_argmin((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1)
    at = (least & low).astype(np.int64)
    turns = np.ones(len(at) + 1, dtype=bool)
    turns[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(turns)
    first, last = edges[:-1], edges[1:] - 1
    first, last = first[kept := inside[first]], last[kept]
    return hashes[at[first]], at[first], first, last


def anchors(raw: np.ndarray, length: int, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first, last): the strings of ``length`` bytes that start from first to last have this anchor.

    offsets: where the texts begin and end that lie one after another in ``raw``; no string goes over an end.
    """
    offsets = np.array([0, len(raw)]) if offsets is None else offsets
    long = np.diff(offsets) >= length
    step = np.zeros(max(len(raw) - length + 1, 0) + 1, dtype=np.int8)  # texts with a string begin at different places
    step[offsets[:-1][long]] += 1
    step[offsets[1:][long] - length + 1] -= 1
    inside = np.cumsum(step, dtype=np.int8)[:-1].view(bool)
    parts, stride = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)], piece_for(length) - length
    for at in range(0, len(inside), stride):
        mine = inside[at : at + stride]
        if mine.any():
            h, p, a, b = _anchors_of_piece(raw[at : at + len(mine) + length - 1], mine, length)
            parts.append((h, p + at, a + at, b + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def window_prints(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 11) -> np.ndarray:
    """64-bit fingerprints of raw[begin:end], ``begin`` in order. Independent for each salt."""
    out = np.zeros(len(begin), dtype=np.uint64)
    if not len(begin):
        return out
    step = piece_for(int((end - begin).max()))
    up, down = _up_and_down(2 * step)
    edges = np.searchsorted(begin, np.arange(0, len(raw) + step, step))
    for at, lo, hi in zip(range(0, len(raw), step), edges[:-1], edges[1:], strict=True):
        part = raw[at : at + 2 * step].astype(np.uint16)[: int(end[lo:hi].max(initial=at)) - at]
        pairs = _PAIR[salt][(part[:-1] << 8) | part[1:]]
        sums = np.zeros(len(pairs) + 1, dtype=np.uint64)
        np.cumsum(pairs * up[: len(pairs)], out=sums[1:])
        a, b = begin[lo:hi] - at, end[lo:hi] - at
        out[lo:hi] = mix((sums[b - 1] - sums[a]) * down[a] + mix((b - a).astype(np.uint64) + np.uint64(salt)))
    return out
