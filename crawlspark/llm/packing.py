"""Packing of tokenised documents into sequences of at most ``window`` tokens by best-fit decreasing.

Every document is its token ids followed by one end id. Overlong documents are first cut into full windows; the
remaining pieces are placed in order of decreasing length, each in the open window that it leaves the least room in. A
segment tree over the remaining capacities finds that window. A task packs what its own partition holds, in groups of
about ``group_tokens`` tokens: nothing is shuffled, no group grows with the input, and a lost task is simply run again.

Defined results: a null or empty text is the end id alone; a null id stays null; repeated rows are documents of their
own; an empty table gives an empty table; other columns are left out. Sequence ids are unique, not contiguous.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import small_batches

#: Fixed value: the pattern by which byte-level BPE splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A task's sequence ids start at its partition number times this.
IDS_PER_TASK = 1 << 32


class OpenWindows:
    """A segment tree over remaining capacities 0..window; each node knows how many open windows lie below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def push(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the open window with the least capacity that is not below ``need``."""
        i = need + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; sequences are numbered from 0."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    windows, n = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = windows.pop_tightest(lengths[i])
        capacity, sequence = found or (window, n)
        n += found is None
        placed[i] = (sequence, window - capacity)
        if capacity > lengths[i]:
            windows.push(capacity - lengths[i], sequence)
    return placed


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _rank_encoding(path: str) -> tiktoken.Encoding | None:
    """The vocabulary of a byte-level BPE file as ranks, if its ids follow the order of its merges (the ids are then the same)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not plain or any(x >= y for x, y in zip(ids, ids[1:])):
        return None
    of = _byte_of_character()
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {t: i for t, i in ranks.items() if i not in special.values()}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class TextTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    A byte-level BPE file whose ids follow its merges is run by its ranks, which gives the same ids in a fraction of the
    time; any other file is run by its own library, and so is a text whose runs of white space are too long for the
    pattern's backtracking.
    """

    def __init__(self, path: str):
        self.path = path
        self.ranks = _rank_encoding(path)

    @cached_property
    def tokenizer(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if self.ranks:
            try:
                return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # "Max stack size exceeded for backtracking"
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0, group_tokens: int = 8_000_000) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id and offset."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextTokenizer(tokenizer)
        base = TaskContext.get().partitionId() * IDS_PER_TASK
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kind = None

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 2000):
                cols = list(zip(*rows[i : i + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names[1:], cols[1:], strict=True)]], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, tokens, base
            placed = best_fit_decreasing([p[2] for p in pieces], window)
            rows = [(*p, base + s, at) for p, (s, at) in zip(pieces, placed, strict=True)]
            base += 1 + max((s for s, _ in placed), default=-1)
            pieces, tokens = [], 0
            yield from emit(rows)

        pieces: list[tuple] = []
        tokens = 0
        for batch in batches:
            kind = batch.column(0).type
            full = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(value.as_py() or "") + end
                n = len(ids) // 4
                cut = n - n % window
                for start in range(0, cut, window):
                    full.append((doc, start, window, ids[4 * start : 4 * (start + window)], n, base, 0))
                    base += 1
                if cut < n:
                    pieces.append((doc, cut, n - cut, ids[4 * cut :], n))
                    tokens += n - cut
            yield from emit(full)
            if tokens >= group_tokens:
                yield from flush()
        if pieces:
            yield from flush()

    return docs.select(id_col, text).mapInArrow(pack, f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
