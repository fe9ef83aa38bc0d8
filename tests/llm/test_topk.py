import math
import random

from crawlspark.llm import topk
from crawlspark.llm.topk import top_k_inner_product


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k_inner_product(df, lambda i: i % 20 == 0, **more).collect())


def f32(rng):
    return round(rng.gauss(0, 1) * 4096) / 4096


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [f32(rng) * (1 + i % 3) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, [1.0] * 12), (404, []), (405, [3.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert run(spark, rows, head=3) == brute(rows)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 5.0])]
    assert run(spark, rows) == [(0, 1, 1, 8192), (0, 2, 1, 8192), (0, 3, 2, -4096)]


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 4


def test_components_beyond_the_narrow_types(spark):
    rows = [(i, [(-1.0) ** i * 2.0 ** (3 * i), 1.0]) for i in range(0, 12)] + [(20, [3.0e3, -7.0])]
    assert run(spark, rows) == brute(rows)
