"""Classes of a bucket dealt over blocks of bounded size, and links confirmed on whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .shingles import shingle_sets


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, scratch: Scratch) -> DataFrame:
    """(node, text) of the wanted classes: the text of the class's representative, once."""
    keys = scratch.save(wanted.join(nodes.select("node", "id", "th").hint("merge"), "node"), "wanted")
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__th"), F.col(text).alias("text"))
    met = rows.join(keys.hint("merge"), (F.col("__id") == F.col("id")) & (F.col("__th") == F.col("th")))
    return scratch.save(met.dropDuplicates(["__id", "__th", "node"]).select("node", "text"), "texts")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def confirm_stars(stars: DataFrame, texts: DataFrame, words: int, star: int, scratch: Scratch) -> DataFrame:
    """(node, lead) -> (u, v), those whose full sets are linked. The members of a star lie in tasks of about ``star``."""
    sizes = scratch.save(stars.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("tasks")), "stars")
    members = stars.join(sizes.hint("merge"), "lead").withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int"))
    members = members.select("node", "lead", "task").join(texts.hint("merge"), "node").select("lead", "task", F.lit(1).alias("kind"), "node", "text")
    centres = sizes.join(texts.withColumnRenamed("node", "lead").hint("merge"), "lead").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    rows = members.unionByName(centres.select("lead", "task", F.lit(0).alias("kind"), F.col("lead").alias("node"), "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            sets, kinds = shingle_sets(batch.column(3), words), batch.column(1).to_pylist()
            keep = np.zeros(len(sets), dtype=bool)
            for k, s in enumerate(sets):
                if kinds[k] == 0:
                    centre = s
                else:
                    keep[k] = linked(centre, s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["u", "v"]).filter(pa.array(keep))

    dealt = rows.repartition("lead", "task").sortWithinPartitions("lead", "task", "kind", "node").select("lead", "kind", "node", "text")
    return scratch.save(dealt.mapInArrow(compare, "u long, v long"), "links")


def blocks(live: DataFrame, weight: str, block: float, scratch: Scratch) -> DataFrame:
    """live (bucket, node, comp, ...) -> with the blocks (p, q) that compare its rows, and side: 0 against 1, or 2 among themselves.

    The others of a bucket are dealt over k parts, its heaviest component over m more; block (p, q) has two parts, and
    no block has two parts of that component.
    """
    weights = live.groupBy("bucket", "comp").agg(F.sum(weight).alias("w"))
    shape = weights.groupBy("bucket").agg(F.sum("w").alias("all"), F.max(F.struct("w", "comp")).alias("main"))
    parts = lambda w: F.greatest(F.ceil(w / block), F.lit(1)).cast("int")
    shape = scratch.save(shape.select("bucket", F.col("main.comp").alias("main"), parts(F.col("all") - F.col("main.w")).alias("k"), parts(F.col("main.w")).alias("m")), "shape")
    dealt, h = live.join(shape.hint("merge"), "bucket"), F.xxhash64("node", F.lit(1))
    is_main = F.col("comp") == F.col("main")
    dealt = dealt.withColumn("mine", F.when(is_main, F.col("k") + F.pmod(h, F.col("m"))).otherwise(F.pmod(h, F.col("k"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("k") - 1).otherwise(F.col("k") + F.col("m") - 1))))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return dealt.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other"), "side": side}).drop("main", "k", "m", "mine", "other")


def each_block(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Applies ``work`` to the rows of each block; rows are in order of their first three columns, the block's name."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and tuple(key[a]) != name:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                name = tuple(key[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield from work(pa.Table.from_batches(held))
