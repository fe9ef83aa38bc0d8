import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crawlspark.llm import suffix_dedup
from crawlspark.llm.anchors import anchors
from crawlspark.llm.run_index import RunIndex, repeated_starts
from crawlspark.llm.suffix_dedup import repeated_bytes, word_codes

N = 400


def brute(rows):
    seen = Counter(b[k : k + N] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - N + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - N + 1):
            if seen[b[k : k + N]] > 1:
                gone[k : k + N] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((i, bytes(x for x, g in zip(b, gone) if not g), len(b), int(gone.sum()), spans))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, other = text(700), text(399)
    rows = [(i, text(rng.randint(0, 900)) + passage[: rng.randint(350, 700)] + text(rng.randint(0, 300))) for i in range(12)]
    rows += [(20 + i, text(200) + other + text(200)) for i in range(3)]
    whole = text(1500)
    rows += [(30, whole), (31, whole), (31, whole), (32, whole[:900]), (33, "ab" * 600), (34, None), (35, ""), (36, "x" * 399), (37, "y" * 400), (38, "y" * 401), (None, whole[200:1000])]
    near = list(text(2000))
    for i in range(4):
        copy = list(near)
        copy[500 + 37 * i] = "Z"
        rows.append((40 + i, "".join(copy)))
    return rows


@pytest.mark.parametrize("index_bytes", [1 << 20, 1200, 0])
def test_against_brute_force(docs, monkeypatch, index_bytes):
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", index_bytes)
    rows = corpus()
    got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, len(r.spans)) for r in repeated_bytes(docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(docs):
    assert repeated_bytes(docs([])).collect() == []


def test_matching_statistics():
    rng = random.Random(9)
    for alphabet in (b"ab", b"abcdefgh", b"a", b"ab\0"):
        strings = list({bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(30)})
        text = b"".join(s + b"\xff" for s in strings)
        index = RunIndex(np.frombuffer(text, dtype=np.uint8))
        got = index.statistics()
        match = lambda a, b: next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 0)
        want = [max(match(a, b) for b in range(len(text)) if b != a) for a in range(len(text))]
        assert got.tolist() == want
    assert [x.tolist() for x in repeated_starts([b"abcdx", b"zabcd", b"q"], 3)] == [[True, True, False], [False, True, True], []]


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 100, 900).astype(np.uint8)
    where = []
    for n in (0, 313, 5000):
        raw = np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared])
        h, p, a, b = anchors(raw, N)
        assert a[0] == 0 and b[-1] == len(raw) - N and (a[1:] == b[:-1] + 1).all()
        where.append([(int(h[k]), int(p[k]) - s) for s in range(n, n + 501) for k in [np.searchsorted(b, s)]])
    assert [w[0] for w in where[0]] == [w[0] for w in where[1]] == [w[0] for w in where[2]]


def test_passages_of_words_are_reported(docs):
    rng = random.Random(12)
    words = lambda n: [rng.choice("aI") if rng.random() < 0.3 else "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    fifty_one, fifty, long = words(51), words(50), words(170)
    rows = [(i, f"{' '.join(words(30))} {' '.join(p)} {' '.join(words(40))}") for i, p in enumerate([fifty_one, fifty_one, fifty, fifty, long, long, words(60)])]
    other = fifty_one[:25] + ["other"] + fifty_one[26:]
    rows += [(9, None), (10, ""), (11, " \n\t".join(fifty_one)), (12, " ".join(other)), (13, " ".join(words(9) + long[:60] + words(9) + long[100:160]))]
    want = {}
    seen = Counter(tuple(w[k : k + 51]) for _, t in rows for w in [(t or "").split()] for k in range(len(w) - 50))
    for i, t in rows:
        w = (t or "").split()
        hit = np.zeros(len(w) + 1, dtype=np.int8)
        for k in range(len(w) - 50):
            if seen[tuple(w[k : k + 51])] > 1:
                hit[k : k + 51] = 1
        want[i] = int((np.diff(hit, prepend=0) == 1).sum())
    got = {r.doc_id: (r.n_passages, r.n_removed > 0) for r in repeated_bytes(docs(rows), passage=51).collect()}
    assert {i: n for i, (n, _) in got.items()} == want
    assert want[0] == want[11] == 1 and want[13] == 2 and want[2] == want[6] == want[12] == want[9] == 0
    assert got[4][1] and got[5][1] and not got[0][1]
    plain = repeated_bytes(docs(rows))
    assert "n_passages" not in plain.columns


def test_word_codes():
    texts = ["a b  ab", "ab", None, "", " ", "ba\ta", "a"]
    codes = word_codes(pa.array(texts)).to_pylist()
    code = {w: word_codes(pa.array([w])).to_pylist()[0] for w in ("a", "b", "ab", "ba")}
    assert len(set(code.values())) == 4
    assert codes == ["".join(code[w] for w in (t or "").split()) for t in texts]


def test_batches_cut_at_text_ends():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (0, 399, 400, 401, 0, 5000, 90)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = list(zip(*(x.tolist() for x in anchors(np.concatenate(texts), N, offsets)), strict=True))
    single = [(h, p + o, a + o, b + o) for t, o in zip(texts, offsets.tolist(), strict=False) for h, p, a, b in zip(*(x.tolist() for x in anchors(t, N)), strict=True)]
    assert together == single
