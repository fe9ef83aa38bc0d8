"""A run-length index of a bounded text: run-compressed Burrows-Wheeler transform with samples at the run ends.

``RunIndex`` sorts the suffixes, derives the transform and keeps, for each of its runs, the text positions at the run's
two ends and the length of their match with the suffix on the other side of the run's border. Those samples are all that matching statistics need: within a run, the match of a suffix with its neighbour is
one byte shorter than that of the suffix one position before, so the statistics of every position stream out of the
samples in the order of the text.
"""

from __future__ import annotations

import numpy as np

#: No byte of UTF-8; it stands between strings and after the last.
SEPARATOR = 0xFF
_BYTES = np.array([1 << (8 * k) for k in range(8)], dtype=np.uint64)


class RunIndex:
    def __init__(self, text: np.ndarray):
        """text: bytes of strings, each followed by SEPARATOR."""
        self.n = len(text)
        padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)  # the end sorts first
        words = np.zeros(self.n, dtype=np.uint64)
        for j in range(8):
            words = (words << np.uint64(8)) | padded[j : j + self.n]
        order = self._sort(words)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # nothing stands before the whole text
        border = np.flatnonzero(before[1:] != before[:-1])
        self.up = (order[border + 1], self._match(words, order[border + 1], order[border]))
        self.down = (order[border], self.up[1])
        self.first, self.last = int(order[0]), int(order[-1])

    @staticmethod
    def _sort(words: np.ndarray) -> np.ndarray:
        """The suffixes in order, by prefix doubling over those that are not told apart yet.

        Two ranks and a position share one 64-bit number, so that a plain sort orders them: that is what bounds the text.
        """
        n, bits = len(words), np.int64(21)
        if n >= 1 << 21:
            raise ValueError("an index holds less than two million bytes")
        low = (np.int64(1) << bits) - 1
        order = np.argsort(words)
        ordered = words[order]
        begins = np.ones(n + 1, dtype=bool)
        np.not_equal(ordered[1:], ordered[:-1], out=begins[1:n])
        rank = np.full(n + 1, -1, dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(begins[:n], np.arange(n, dtype=np.int32), 0))
        depth, places = 8, np.arange(n)
        while True:
            places = places[~(begins[places] & begins[places + 1])]
            if not len(places):
                return order
            at = order[places]
            key = np.sort((rank[at].astype(np.int64) << (2 * bits)) | ((rank[np.minimum(at + depth, n)].astype(np.int64) + 1) << bits) | at)
            at, key = key & low, key >> bits
            new = np.ones(len(key), dtype=bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            order[places] = at
            begins[places] = new
            rank[at] = np.maximum.accumulate(np.where(new, places, 0))
            depth *= 2

    def _match(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the match of the suffixes a and b."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        at = 0
        while len(live):
            x, y = a[live] + at, b[live] + at
            inside = (x < self.n) & (y < self.n)
            live, x, y = live[inside], x[inside], y[inside]
            differ = words[x] ^ words[y]
            same = differ == 0
            # The highest byte that differs says how many bytes agree.
            out[live[~same]] = at + 8 - np.searchsorted(_BYTES, differ[~same], side="right")
            out[live[same]] = at + 8
            live = live[same]
            at += 8
        return np.minimum(out, self.n - np.maximum(a, b))

    def statistics(self) -> np.ndarray:
        """For every position, the length of the longest match of its suffix with another one."""
        best = np.zeros(self.n, dtype=np.int64)
        place = np.arange(self.n)
        for (at, value), lone in ((self.up, self.first), (self.down, self.last)):
            sample = np.full(self.n, -1, dtype=np.int64)
            sample[at] = value
            sample[lone] = 0  # no neighbour on this side
            known = np.maximum.accumulate(np.where(sample >= 0, place, 0))
            best = np.maximum(best, np.maximum(sample[known], 0) - (place - known))
        return best


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, whether the ``length`` bytes from each of its positions on start anywhere else in the strings."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), dtype=np.uint8)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    long = RunIndex(text).statistics() >= length
    out, begin = [], 0
    for end in ends.tolist():
        out.append(long[begin : max(end - length + 1, begin)])
        begin = end + 1
    return out
