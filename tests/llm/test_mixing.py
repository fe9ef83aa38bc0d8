import random
import re

import numpy as np
import pytest

from crawlspark.llm.mixing import fit_lengths, knapsack, mix_sources


def targets(sizes):
    """By repeated resharing: sources above three times their size stop, the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix(docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(400)]
    rows += [(900, "one\ttwo\u00a0three", "tiny"), (901, None, "none"), (902, "", "none"), (903, "w " * 3000, "b"), (None, "x y", "b"), (5, rows[5][1], rows[5][2])]
    df = docs(rows)
    out = mix_sources(df).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    source_of = {(i, size(t)): s for i, t, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source_of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, s
    again = mix_sources(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_many_documents_of_one_length(docs):
    out = mix_sources(docs([(i, "a b c", "s" if i % 2 else "t") for i in range(3000)])).collect()
    for s in (0, 1):
        mine = [r for r in out if r.doc_id % 2 == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3


def test_empty_tables(docs):
    assert mix_sources(docs([])).collect() == []
    assert [r.taken for r in mix_sources(docs([(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_knapsack_is_optimal():
    rng = random.Random(3)
    for _ in range(50):
        lengths = rng.sample(range(1, 30), 5)
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 120)
        taken = knapsack(lengths, counts, budget)
        reach = {0}
        for x, c in zip(lengths, counts):
            reach = {r + x * k for r in reach for k in range(c + 1) if r + x * k <= budget}
        assert all(t <= c for t, c in zip(taken, counts)) and sum(t * x for t, x in zip(taken, lengths)) == max(reach)


def test_fit_takes_no_more_than_there_is():
    lengths, counts = np.array([0, 7, 100, 40000]), np.array([5, 10, 10, 10])
    for target in (0, 1, 50, 5000, 399_000, 401_071, 900_000, 10**9):
        whole, extra = fit_lengths(lengths, counts, target, 3, 1)
        assert (extra <= counts).all() and extra[0] == 0 and whole <= 3
        assert (lengths * (counts * whole + extra)).sum() <= target + 1


def test_long_documents_in_a_small_source():
    rng = random.Random(5)
    cases = [([60_000, 99_000, 41_000], [1, 1, 1], 100_000)]
    cases += [([rng.randint(33_000, 400_000) for _ in range(9)], [rng.randint(1, 2) for _ in range(9)], rng.randint(200_000, 1_500_000)) for _ in range(20)]
    for lengths, counts, target in cases:
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums |= {s + n * k for s in sums for k in range(1, c + 1)}
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        best = max(s for s in sums if s <= target % total) + target // total * total
        for seed in range(4):
            whole, extra = fit_lengths(np.array(lengths), np.array(counts), float(target), 3, seed)
            taken = int((np.array(lengths) * (whole * np.array(counts) + extra)).sum())
            assert (extra <= counts).all() and taken <= target
            assert best - taken <= 32_768 + 0.001 * target, (lengths, counts, target)
