import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crawlspark.llm.packing import TextTokenizer, best_fit_decreasing, pack_documents

BPE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "a  b", "", " ", "\n", "x\n\ny", "a \n b", "<|endoftext|> x", "tab\tx y", "don't I'm\nx's", " lead", "trail ", "é b c", "a\u3000b c", "123 456\n7", "\x1cx y\x85z w",
    "end\n", "\nstart x", "naïve ﬁ 你好 🙂 \u200d", "\x00\x01", "A" * 5000, "word " * 3000,
]


@pytest.mark.parametrize("path", [BPE, WORDS])
def test_ids_are_the_librarys(path):
    own, library = TextTokenizer(path), Tokenizer.from_file(path)
    assert bool(own.ranks) == (path == BPE)
    for t in TEXTS:
        assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t[:40]


def test_pieces_are_the_documents(docs):
    rows = list(enumerate(TEXTS)) + [(50, None), (50, None), (None, "x"), (60, "lorem ipsum " * 20_000)]
    out = pack_documents(docs(rows), BPE, group_tokens=3000).collect()
    library = Tokenizer.from_file(BPE)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in rows}
    for i in ids:
        copies = sum(1 for j, _ in rows if j == i)
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == copies * len(ids[i]) and all(r.doc_tokens == len(ids[i]) for r in mine)
        for r in mine:
            assert zlib.crc32(bytes(r.ids)) == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_best_fit_decreasing_finds_the_tightest():
    rng = random.Random(5)
    for _ in range(20):
        lengths = [rng.randint(1, 64) for _ in range(200)]
        placed = best_fit_decreasing(lengths, 64)
        room, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fitting = [r for r in room if r >= lengths[i]]
            if fitting:
                room.remove(min(fitting))
            room.append((min(fitting) if fitting else 64) - lengths[i])
        used = {}
        for (s, _), n in zip(placed, lengths):
            used[s] = used.get(s, 0) + n
        assert sorted(64 - u for u in used.values()) == sorted(room), want


def test_empty_table(docs):
    assert pack_documents(docs([]), BPE).collect() == []


@pytest.mark.parametrize("text", [" " * 1_200_000, "a" + "\n" * 1_200_000 + "b", "<|endoftext|>x" + " \t" * 600_000 + "é <|endoftext|>"])
def test_long_runs_of_white_space(text):
    own, library = TextTokenizer(BPE), Tokenizer.from_file(BPE)
    assert own.ranks and own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_long_run_among_other_documents(docs):
    out = pack_documents(docs([(1, "a b"), (2, " " * 1_200_000), (3, "c")]), BPE).select("doc_id", "doc_tokens").distinct().collect()
    n = len(Tokenizer.from_file(BPE).encode(" " * 1_200_000, add_special_tokens=False).ids) + 1
    assert {r.doc_id for r in out} == {1, 2, 3} and {r.doc_tokens for r in out if r.doc_id == 2} == {n}
