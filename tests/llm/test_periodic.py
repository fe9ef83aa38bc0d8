import hashlib
import random
import re
import zlib

import numpy as np

from crawlspark.llm.periodic import find_runs, periodic_runs
from crawlspark.llm.queries import with_planted_period


def brute(words, min_words=6, min_periods=4):
    runs, n = [], len(words)
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_words, min_periods * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                runs.append((i, length, q))
            i = max(i, j) + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_texts():
    rng = random.Random(5)
    for least in (4, 4, 2):
        for _ in range(150):
            texts = []
            for _ in range(3):
                w = []
                while rng.random() < 0.9 and len(w) < 100:
                    w += [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
                texts.append(w[: len(w) - rng.randrange(3)] if w else w)
            first = np.cumsum([0] + [len(t) for t in texts])
            found = find_runs(np.array(sum(texts, []), dtype=np.int64), np.repeat(np.arange(3), [len(t) for t in texts]), min_periods=least)
            assert list(zip(*(x.tolist() for x in found), strict=True)) == [(s + first[i], n, q) for i, t in enumerate(texts) for s, n, q in brute(t, 6, least)]


def test_long_runs():
    for words, period in ((np.zeros(100_000, dtype=np.int64), 1), (np.arange(100_000) % 900, 900)):
        start, length, found = find_runs(words, np.zeros(len(words), dtype=np.int64))
        assert (start.tolist(), length.tolist(), found.tolist()) == ([0], [100_000], [period])


def test_texts(docs):
    texts = ["a b " * 8 + "c", "x\ty\x0bz " * 20 + "end " * 6, None, "", " \n ", "one two three", "É é " * 4 + "ü", "a b c a b c a b c a b", "\x1f w\x85 " * 5, "k " * 50_000 + "l", "q q " * 7]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    out = periodic_runs(docs(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        words = words_of(texts[1] if r.doc_id is None else texts[r.doc_id])
        runs = [(0, 50_000, 1)] if r.doc_id == 9 else brute(words)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapse(words, runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


def test_empty_table(docs):
    assert periodic_runs(docs([])).collect() == []


def test_planted_periods(docs):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 60))) for i in range(200)] + [(None, "a b c"), (7, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in with_planted_period(docs(rows)).collect())
    want = []
    for i, text in rows:
        w, h = words_of(text), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        want.append((-1 if i is None else i, " ".join(w)))
    assert got == sorted(want)
