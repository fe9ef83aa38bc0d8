"""Mixing sources to target weights by fitting each source's budget as a subset sum.

Every source gets a target number of words: the whole corpus's words shared out by weight, with a source's target
stopped at ``max_repeats`` times its own words and the excess reshared. A source is then repeated whole as often as
its target allows, and the rest of its budget is fitted over the counts of documents of each exact length: an equal
share of every length first, then lengths in a seeded order, and a bounded-knapsack dynamic programme for what is
left. Which documents of a length are taken follows a seeded hash. A length's documents are spread over
``HASH_BUCKETS`` ranges of that hash, so that no task needs all documents of a source or of a length: whole ranges are
taken by their counts, and only within the one range where the count runs out are documents ranked.

Defined results: a null text has size 0; a document of size 0 is never counted as taken; a null source is a source of
its own and sorts last; repeated rows are documents of their own (rows equal in all of id, source and text may be
taken a different number of times); an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

HASH_BUCKETS = 1024
#: The cells of the dynamic programme. A larger rest is filled greedily first; where only documents longer than it are left,
#: the whole budget is fitted in units of several words.
DP_BUDGET = 32_768


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``sizes`` (one row a source) with its target. The windows run over the sources, never over documents."""
    by_name, every = Window.orderBy(F.col(source).asc_nulls_last()), Window.partitionBy(F.lit(1))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    capped = sizes.withColumn("__w", weight).withColumn("__cap", F.col(size) * float(max_repeats)).withColumn("__r", F.col("__cap") / F.col("__w"))
    before = Window.orderBy("__r", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(size).over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    heavy = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    #: The words per unit of weight if exactly the sources before this one stop at their caps.
    level = capped.withColumn("__level", left / heavy)
    level = level.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__r", "__level"))).over(every)["__level"])
    return level.withColumn("target", F.when(F.col("__r") <= F.col("__level"), F.col("__cap")).otherwise(F.col("__w") * F.col("__level"))).drop("__w", "__cap", "__r", "__level")


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length (at most its count) to take for the largest sum that is not above ``budget``."""
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    parent = np.full(budget + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        if reached[budget]:
            break
        count, step = min(count, budget // length if length else 0), 1
        while count > 0:
            step = min(step, count)
            weight = length * step
            new = np.flatnonzero(reached[: budget + 1 - weight] & ~reached[weight:]) + weight
            parent[new] = len(items)
            reached[new] = True
            items.append((i, step))
            count, step = count - step, step * 2
    taken = [0] * len(lengths)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, step = items[parent[at]]
        taken[i] += step
        at -= lengths[i] * step
    return taken


def _fill(lengths: np.ndarray, counts: np.ndarray, extra: np.ndarray, left: int, seed: int) -> tuple[np.ndarray, int]:
    """Takes more documents while they fit: lengths in a seeded order, then the programme for a rest of up to DP_BUDGET."""
    extra = extra.copy()
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if lengths[i] and left > DP_BUDGET:
            more = min(int(counts[i] - extra[i]), (left - DP_BUDGET + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
            extra[i] += more
            left -= more * int(lengths[i])
    if 0 < left <= DP_BUDGET:
        order = np.random.default_rng(seed + 1).permutation(len(lengths))
        order = order[(lengths[order] > 0) & (counts[order] > extra[order])]
        more = np.array(knapsack([int(x) for x in lengths[order]], [int(x) for x in (counts - extra)[order]], left), dtype=np.int64)
        extra[order] += more
        left -= int((lengths[order] * more).sum())
    return extra, left


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float, max_repeats: int, seed: int) -> tuple[int, np.ndarray]:
    """(times that every document is taken, number of documents of each length that are taken once more)."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), dtype=np.int64)
    whole = min(max_repeats, int(target // total)) if total else 0
    budget = int(round(target - whole * total)) if total and whole < max_repeats else 0
    if budget <= 0:
        return whole, extra
    extra = np.where(lengths > 0, np.floor(counts * (budget / total)).astype(np.int64), 0)
    extra, left = _fill(lengths, counts, extra, budget - int((lengths * extra).sum()), seed)
    if left > DP_BUDGET:  # every document left is longer than the rest: other choices of long ones may come nearer
        unit, order = -(-budget // DP_BUDGET), np.flatnonzero((lengths > 0) & (lengths <= budget))
        coarse = np.zeros(len(lengths), dtype=np.int64)
        coarse[order] = knapsack([-(-int(x) // unit) for x in lengths[order]], [int(x) for x in counts[order]], budget // unit)
        other, rest = _fill(lengths, counts, coarse, budget - int((lengths * coarse).sum()), seed)
        extra = other if rest < left else extra
    return whole, extra


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: int = 42, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target (both of its source), taken, in words, and the columns in ``carry``."""
    scratch = Scratch(docs.sparkSession)
    drawn = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text), F.lit("")))
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"), drawn.alias("__h"), *carry)
    sized = scratch.save(sized.withColumn("__b", F.shiftrightunsigned("__h", 54).cast("int")), "sized")
    ranges = scratch.save(sized.groupBy("__source", "__size", "__b").agg(F.count(F.lit(1)).alias("__n")), "ranges")
    lengths = ranges.groupBy("__source", "__size").agg(F.sum("__n").alias("__n"))
    sources = lengths.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("source_size"))
    targets = scratch.save(source_targets(sources, "__source", "source_size", weights, max_repeats), "targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__size", kind="stable")
        whole, extra = fit_lengths(pdf["__size"].to_numpy(np.int64), pdf["__n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), max_repeats, seed)
        return pdf.assign(__whole=whole, __extra=extra)[["__source", "__size", "source_size", "target", "__whole", "__extra"]]

    kind = docs.schema[source].dataType.simpleString()
    same_source = lambda a, b: a["__source"].eqNullSafe(b["__source"])
    fitted = (
        lengths.join(targets, same_source(lengths, targets)).drop(targets["__source"])
        .groupBy("__source").applyInPandas(fit, f"__source {kind}, __size long, source_size long, target double, __whole long, __extra long")
    )
    fitted = scratch.save(fitted, "fitted")
    up_to = Window.partitionBy("__source", "__size").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cuts = ranges.join(fitted, same_source(ranges, fitted) & (ranges["__size"] == fitted["__size"])).drop(fitted["__source"], fitted["__size"])
    cuts = cuts.withColumn("__take", F.col("__extra") - F.sum("__n").over(up_to) + F.col("__n"))
    cuts = scratch.save(cuts.drop("__n", "__extra"), "cuts")
    rank = F.row_number().over(Window.partitionBy("__source", "__size", "__b").orderBy("__h", "__id"))
    joined = sized.join(cuts, same_source(sized, cuts) & (sized["__size"] == cuts["__size"]) & (sized["__b"] == cuts["__b"])).drop(cuts["__source"], cuts["__size"], cuts["__b"])
    return joined.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * (F.col("__whole") + F.when(rank <= F.col("__take"), 1).otherwise(0))).alias("taken"),
        *carry,
    )
