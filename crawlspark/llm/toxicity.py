"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed n-grams that its lower-cased text has at least once. Of a bounded sample of
labelled documents (``max_per_class`` of each class, those with the smallest hashes of their ids), the ratio
r = log((documents of class 1 with the feature + 1) / (class 1 documents + 2)) - the same for class 0 is counted on the
cluster; features are used whose r is at least ``min_z`` standard errors from 0, at most ``max_features`` of them, the
surest first, so that a long text's many rare n-grams don't add up to evidence. A logistic regression over features of
value r, both classes of the same weight, is fitted to the same sample, and executors score every whole text.

Defined results: null and empty texts have no features and get the score of the intercept; labels that are null, or
whose document is missing, are not used; of several labels of a document the largest counts; without a labelled
document of either class the score is the smoothed share of class 1. Other columns pass through; those named like a
result column are replaced. Very long texts are cut into overlapping pieces inside a task and counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .scratch import Scratch

NGRAMS = (3, 4, 5)
BUCKET_BITS = 18
PIECE_CHARS = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def ngram_features(texts: list[str], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, slot) pairs in order; ``slots`` maps each bucket to a slot, or to -1 if it is not used."""
    pieces: list[tuple[int, str]] = []
    for i, text in enumerate(texts):
        low = text.lower()
        step = PIECE_CHARS - max(NGRAMS)
        pieces += [(i, low[at : at + PIECE_CHARS]) for at in range(0, max(len(low) - max(NGRAMS), 0) + 1, step)]
    width, found = int(slots.max(initial=0)) + 1, [np.zeros(0, dtype=np.int64)]
    while pieces:
        group, chars = [], 0
        while pieces and (not group or chars + len(pieces[-1][1]) <= PIECE_CHARS):
            group.append(pieces.pop())
            chars += len(group[-1][1])
        points = np.frombuffer("".join(p for _, p in group).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
        owner = np.repeat(np.array([i for i, _ in group], dtype=np.int64), [len(p) for _, p in group])
        piece = np.repeat(np.arange(len(group), dtype=np.int32), [len(p) for _, p in group])
        sums = points * _MULTIPLIER
        for n in range(2, max(NGRAMS) + 1):
            if len(points) < n:
                break
            sums = (sums[:-1] ^ (sums[:-1] >> np.uint64(29))) * _MULTIPLIER + points[n - 1 :]
            if n in NGRAMS:
                mixed = (sums ^ (sums >> np.uint64(32))) * _MULTIPLIER
                slot = slots[(mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                hit = np.flatnonzero((slot >= 0) & (piece[: len(slot)] == piece[n - 1 :]))
                found.append(np.unique(owner[hit] * width + slot[hit]))
    pairs = np.unique(np.concatenate(found))
    return pairs // width, pairs % width


def _fit_logistic(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, ratios: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss over features of value ratio; rows and slots name the features that are present."""
    w, b = np.zeros(len(ratios)), 0.0
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    value = ratios[slots]
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        margin = b + np.bincount(rows, weights=w[slots] * value, minlength=len(labels))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * share
        gradient = np.append(np.bincount(slots, weights=error[rows] * value, minlength=len(w)) + l2 * w, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = 0.02 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = 2500, max_features: int = 1 << 14, min_z: float = 3.0) -> Model:
    """``labels`` holds id and label of the rows that may be learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("__y"))
    # Only ids are drawn here: two bounded lists.
    sample = [known.where(F.col("__y") == y).orderBy(F.xxhash64(F.lit(1), id_col), id_col).limit(max_per_class) for y in (0, 1)]
    sample = F.broadcast(spark.createDataFrame([tuple(r) for part in sample for r in part.collect()], known.schema))
    every = np.arange(1 << BUCKET_BITS, dtype=np.int32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = ngram_features([t or "" for t in batch.column(1).to_pylist()], every)
            lists = np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["y", "buckets"])

    drawn = docs.select(id_col, text).join(sample, id_col).select("__y", text).mapInArrow(features, "y int, buckets array<int>")
    drawn = scratch.save(drawn, "sample")
    n = {r["y"]: r["count"] for r in drawn.groupBy("y").count().collect()}
    negative, positive = n.get(0, 0), n.get(1, 0)
    prior = float(np.log((positive + 0.5) / (negative + 1.5)))  # nothing known: not toxic
    if not negative or not positive:
        scratch.drop(drawn)
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    counts = drawn.select("y", F.explode("buckets").alias("b")).groupBy("b").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    ratio = F.log((F.col("p") + 1) / (positive + 2.0)) - F.log((F.col("n") - F.col("p") + 1) / (negative + 2.0))
    sureness = F.abs(ratio) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("n") - F.col("p") + 1))
    best = counts.select("b", ratio.alias("r"), sureness.alias("z")).where(F.col("z") >= min_z).orderBy(F.desc("z"), "b").limit(max_features).toPandas().sort_values("b")
    buckets, ratios = best["b"].to_numpy(np.int64), best["r"].to_numpy(np.float64)
    chosen = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    chosen[buckets] = np.arange(len(buckets), dtype=np.int32)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.sort((s := chosen[np.asarray(x, dtype=np.int64)])[s >= 0]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in lists], pa.binary())], ["y", "slots"])

    # A bounded sample of at most 2 * max_per_class rows; put in one order, so that every run fits the same model.
    matrix = sorted((r["y"], bytes(r["slots"])) for r in drawn.mapInArrow(narrow, "y int, slots binary").collect())
    scratch.drop(drawn)
    rows = np.repeat(np.arange(len(matrix)), [len(x) // 4 for _, x in matrix])
    slots = np.frombuffer(b"".join(x for _, x in matrix), dtype=np.int32)
    w, b = _fit_logistic(rows, slots, np.array([y for y, _ in matrix], dtype=np.float64), ratios)
    return Model(buckets, w * ratios, b)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold)."""
    small_batches(docs.sparkSession)
    weights = np.asarray(model.weights, dtype=np.float64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
        slots[model.buckets] = np.arange(len(model.buckets), dtype=np.int32)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            row, slot = ngram_features([t or "" for t in batch.column(at).to_pylist()], slots)
            margin = model.intercept + np.bincount(row, weights=weights[slot] if len(slot) else None, minlength=batch.num_rows)[: batch.num_rows]
            value = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("score", "predicted")]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(value), pa.array((value >= threshold).astype(np.int32))], [*[n for n, _ in kept], "score", "predicted"])

    plain = docs.drop("score", "predicted") if text not in ("score", "predicted") else docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(apply, f"{schema}, score double, predicted int")


def fold(id_col: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold -1."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(-1))
