import random

import numpy as np

from crawlspark.llm import toxicity

CLEAN = "the quiet river runs along green fields where small birds sing every morning in may".split()
TOXIC = ["idiotxx", "scumzz", "moronqq"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(TOXIC)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark, docs):
    rows = corpus(400)
    df = docs([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels.where(toxicity.fold("doc_id") != 0))
    out = toxicity.score(df, model).join(labels.dropna(), "doc_id").where(toxicity.fold("doc_id") == 0).collect()
    assert len(out) > 50 and np.mean([r.predicted == r.toxic for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    again = toxicity.train(df.repartition(5), labels.where(toxicity.fold("doc_id") != 0))
    assert np.allclose(model.weights, again.weights) and model.intercept == again.intercept

    edge = docs([(1, None), (1, None), (2, ""), (None, "x"), (3, "quiet river " * 200_000), (4, "quiet river " * 200_000 + "idiotxx scumzz moronqq"), (5, "İ" * 10)])
    scored = toxicity.score(edge, model)
    assert scored.count() == 7 and scored.columns.count("score") == 1
    by_id = {r.doc_id: r for r in scored.collect()}
    assert by_id[1].score == by_id[2].score and by_id[3].predicted == 0 and by_id[4].predicted == 1


def test_features_of_pieces(monkeypatch):
    every = np.arange(1 << toxicity.BUCKET_BITS, dtype=np.int32)
    texts = ["", "ab", "The quick brown fox jumps over the lazy dog. " * 3, "é" * 30, "xyz"]
    whole = toxicity.ngram_features(texts, every)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 16)
    parts = toxicity.ngram_features(texts, every)
    assert all((a == b).all() for a, b in zip(whole, parts)) and 0 not in whole[0] and 1 not in whole[0]
    alone = toxicity.ngram_features(texts[2:3], every)[1]
    assert (whole[1][whole[0] == 2] == alone).all()


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs([(1, "a")]), none)
    assert [r.predicted for r in toxicity.score(docs([(1, "some text")]), model).collect()] == [0]
    assert toxicity.score(docs([]), toxicity.train(docs([]), none)).collect() == []
