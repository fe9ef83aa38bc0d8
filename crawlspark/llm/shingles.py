"""Sets of hashed word shingles, computed for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Characters between words: [\x20\x09-\x0D].
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _place(n: int) -> np.ndarray:
    """Odd multipliers for the places within a word."""
    return mix(np.arange(1000, 1000 + n, dtype=np.uint64)) | np.uint64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets); nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, an empty one none."""
    raw, offsets = text_bytes(texts)
    solid = ~BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in range(len(texts))]
    at = np.flatnonzero(solid)
    word = np.cumsum(begins)[at] - 1
    place = at - starts[word]
    values = _BYTE[_LOWER[raw[at]]] * _place(int(place.max()) + 1)[place]
    hashes = mix(np.add.reduceat(values, np.searchsorted(at, starts)))
    weights = _place(words)
    n = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(words):
        rolled += hashes[j : j + n] * weights[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
