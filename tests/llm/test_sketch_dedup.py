import random
import re

import numpy as np

from crawlspark.llm import sketch_dedup
from crawlspark.llm.shingles import mix
from crawlspark.llm.sketch_dedup import sketch_duplicates, sketches

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    """(id, n, component) of rows with different ids."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
        if not changed:
            break
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets.items())


def run(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in sketch_duplicates(df).collect())


def some_documents(seed):
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(4000)}"
    for _ in range(8):  # groups of near copies that drift away from each other, so that links form chains
        text = [word() for _ in range(rng.choice([5, 12, 60, 300]))]
        for _ in range(rng.randint(1, 12)):
            text = text[:]
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(word() for _ in range(40)) for _ in range(20)]
    base = [word() for _ in range(400)]  # many copies of one base that are near 0.7 of each other
    for _ in range(25):
        t = base[:]
        for _ in range(10):
            t[rng.randrange(400)] = word()
        rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(docs):
    rows = some_documents(3)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"), (1006, "É b c d e"), (1007, "é b c d e"), (1008, "x " * 50_000), (1009, "x x x x")]
    assert run(docs(rows)) == brute(rows)


def test_blocks_of_large_buckets(docs, monkeypatch):
    monkeypatch.setattr(sketch_dedup, "BLOCK", 1024)
    monkeypatch.setattr(sketch_dedup, "STAR", 3)
    rows = some_documents(4)
    assert run(docs(rows)) == brute(rows)


def test_repeated_rows_null_ids_and_other_columns(docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (3, text + " more"), (None, text), (9, "other words in this text"), (9, text)]
    out = sketch_duplicates(docs(rows))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out.collect())
    assert got == [(0, 27, None, True), (3, 28, 3, True), (5, 27, 3, False), (5, 27, 3, False), (9, 2, 9, True), (9, 27, 3, False)]


def test_empty_table(docs):
    assert sketch_duplicates(docs([])).collect() == []


def test_sketches_fill_and_estimate():
    numbers = lambda a, b: mix(np.arange(a, b, dtype=np.uint64))
    for n in (1, 2, 10, 100, 5000):
        assert (sketches([numbers(1, n + 1)]) != 0).all()
    apart = []
    for k in range(60):
        x, y = sketches([numbers(k * 1000, k * 1000 + 90), numbers(k * 1000 + 10, k * 1000 + 100)])
        apart.append((x == y).mean())
    assert abs(np.mean(apart) - 0.8) < 0.02 and min(apart) > 72 / 128
    small = [np.mean(np.equal(*sketches([numbers(k * 10 + 1, k * 10 + 5), numbers(k * 10 + 1, k * 10 + 6)]))) for k in range(60)]
    assert abs(np.mean(small) - 0.8) < 0.03 and min(small) > 72 / 128
    assert not sketches([np.zeros(0, dtype=np.uint64)]).any()
