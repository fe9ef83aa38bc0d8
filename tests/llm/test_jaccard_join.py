import random
import re

import numpy as np
import pyarrow as pa
import pytest

from crawlspark.llm import components, jaccard_join
from crawlspark.llm.jaccard_join import near_duplicates
from crawlspark.llm.scratch import Scratch
from crawlspark.llm.shingles import shingle_sets
from crawlspark.llm.signature_tree import bitmap, candidate_pairs

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {n: i for n, (i, _) in enumerate(sets)}
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and least[a] != least[b] and 100 * len(x & y) >= 80 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    out = [(i, len(s), least[n]) for n, (i, s) in enumerate(sets)]
    return sorted(out + [(None, len(shingles(t)), None) for i, t in rows if i is None], key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(8, 150))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize("bucket", [4096, 3])
def test_against_brute_force(docs, monkeypatch, bucket):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rows = corpus()
    rows += [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (905, "a b c d e"), (None, "a b"), (906, "x " * 20_000), (907, "X " * 10), (903, "A b")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_small_parts_blocks_and_stars(docs, monkeypatch):
    for name, value in (("PART", 4), ("BUCKET", 3), ("STAR", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(5)
    # Many near copies of one text, none equal, and a chain in which only neighbours are linked.
    base = [f"v{k}" for k in range(120)]
    rows += [(1000 + k, " ".join([*base, f"own{k}"])) for k in range(30)]
    rows += [(2000 + k, " ".join(f"c{i}" for i in range(10 * k, 10 * k + 120))) for k in range(9)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs(rows)).collect()), key=str)
    assert got == brute(rows)
    assert len({c for i, _, c in got if 1000 <= i < 1030}) == len({c for i, _, c in got if i >= 2000}) == 1


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(200, 201), (201, 202), (203, 202), (300, 300), (7, 100), (41, 40), (50, 51), (51, 50)]
    out = components.components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark)).collect()
    want = {k: 0 for k in [*range(1, 42), *range(100, 120)]} | {201: 200, 202: 200, 203: 200, 51: 50}
    assert {r.node: r.root for r in out} == want and len(out) == len(want)
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).collect() == []


def test_shingles_of_slices_and_nulls():
    texts = ["a b c d e f", None, "", "A  B\tc\nd\x0be", "x", "é ü"] * 3
    sets = shingle_sets(pa.array(texts).slice(1, 15))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts[1:16]]
    assert (sets[2] == shingle_sets(pa.array(["a b c d e"]))[0]).all()


def test_trees_let_every_similar_pair_through():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (5, 30, 200, 700, 3000)]
    sets = []
    for b in base:
        for _ in range(12):
            kept = b[rng.random(len(b)) > rng.choice([0.0, 0.05, 0.15])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, len(b) // 20).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    maps = [bitmap(s) for s in sets]
    true = {(a, b) for b in range(len(sets)) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    own = np.arange(len(sets))
    i, j, _ = candidate_pairs(maps, sizes, own, np.full(len(sets), 2))
    found = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    assert true and true <= found and len(found) < len(sets) ** 2 / 4
    sides = own % 2
    i, j, _ = candidate_pairs(maps, sizes, own, sides)
    found = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    assert {p for p in true if sides[p[0]] != sides[p[1]]} <= found and all(sides[a] != sides[b] for a, b in found)
    i, _, _ = candidate_pairs(maps, sizes, np.zeros(len(sets), np.int64), np.full(len(sets), 2))
    assert not len(i)  # all in one class already
