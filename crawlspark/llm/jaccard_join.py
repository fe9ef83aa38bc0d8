"""Near duplicates: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. Every whole text becomes its set of shingle hashes. Equal sets are one class with one representative.
2. Two sets of similarity 0.8 share one of the n - ceil(0.8 n) + 1 smallest hashes of each (the prefix); classes meet in
   the buckets of their prefix hashes. Only hashes and class numbers are shuffled for that.
3. In a bucket the classes' token bitmaps form a signature tree, whose nodes hold OR-combined bitmaps and size ranges. A
   dual traversal drops pairs of nodes whose largest possible overlap is too small, or which are connected already.
4. The pairs that are left are verified with the whole sets.

The first round uses only the smallest hashes. It deals the classes of a bucket over parts of about ``PART`` by chance,
another deal for every bucket, and takes a spanning forest of each part's pairs, the most similar first. Copies share
all their smallest hashes, so the parts of one bucket are joined by those of another, and nearly all classes that
belong together are, at a cost in proportion to the bucket.

The second round is complete. It uses all prefix hashes and drops buckets that lie in one component. The classes of a
bucket are split by size: a band of sizes meets itself and the next one. Of cells with the same members one is kept, and
cells of one component are dropped. The largest component of a cell is dealt over blocks of about ``BUCKET`` classes that
meet the others only, and the others also each other. Every pair that the trees let through and that no component joins
yet is emitted in slices and verified, so no link between components is lost, and a group of near copies never gives all its pairs.

Defined results: null and empty texts have no shingles and no links; a text of fewer than five words is one shingle;
rows without an id are left out of the groups and get a null component; repeated rows are copies of one class; an
empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .blocks import blocks, confirm_stars, each_block, texts_of
from .components import components
from .scratch import Scratch
from .shingles import mix, shingle_sets
from .signature_tree import bitmap, candidate_slices

#: Classes of one component, or of the others, in a block of the second round. (Joins here are merged by shuffle: both sides grow with the input.)
BUCKET = 4096
#: Classes in a part of the first round.
PART = 512
#: Members of a star of pairs that one task verifies with their centre.
STAR = 512
#: Rows of the second round that are compared at once, as a multiple of the classes: they carry bitmaps, and their shuffle files go with each slice.
SLICE = 3
#: Hashes of the prefix that the first round uses.
FIRST_HASHES = 2
#: Sizes of two linked sets differ by a factor of 1.25 at most, so they lie in one band of this ratio or in two in a row.
BAND = 1.26


def _sets(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, th, n, f1, f2, prefix, map) of each row; f1 and f2 are the fingerprint of the set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2))
            n = [len(s) for s in sets]
            prints = [[int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for k in (0x1F0, 0xA5A5A5)]
            prefix = [s[: len(s) - -(-4 * len(s) // 5) + 1 if len(s) else 0].view(np.int64) for s in sets]
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[pa.array(p, pa.int64()) for p in prints], pa.array(prefix, pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", "n", "f1", "f2", "prefix", "map"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text)
    return rows.mapInArrow(build, f"id {id_type}, th long, n long, f1 long, f2 long, prefix array<long>, map binary")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of the pairs that connect what earlier pairs have not."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if (a := root(a)) != (b := root(b)):
            parent[b] = a
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _traverse(rows: DataFrame, forest: bool) -> DataFrame:
    """rows: (bucket, p, q, side, node, comp, n, map, first) -> (lead, node) pairs of the blocks (bucket, p, q), or forests of them."""

    def batch(block: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        node = block["node"].to_numpy()
        a, b = node[i], node[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["lead", "node"])

    def work(block: pa.Table) -> Iterator[pa.RecordBatch]:
        slices = candidate_slices(block["map"].to_pylist(), block["n"].to_numpy(), block["comp"].to_numpy(), block["side"].to_numpy())
        if not forest:
            for i, j, _ in slices:
                yield batch(block, i, j)
            return
        # The forest of all slices so far takes the most similar pairs first: they will hardly fail the whole sets.
        i, j, similar = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for found in slices:
            i, j, similar = (np.concatenate(x) for x in zip((i, j, similar), found, strict=True))
            order = np.argsort(-similar, kind="stable")
            order = order[_forest(i[order], j[order], block.num_rows)]
            i, j, similar = i[order], j[order], similar[order]
        yield batch(block, i, j)

    ordered = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "first", "node")
    cols = ordered.select("bucket", "p", "q", "side", "node", "comp", "n", "map")
    return cols.mapInArrow(lambda batches: each_block(batches, work), "lead long, node long").distinct()


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text: str) -> DataFrame:
    """The (u, v) of pairs whose whole sets have a similarity of 0.8 or more."""
    texts = texts_of(pairs.select(F.explode(F.array("lead", "node")).alias("node")).distinct(), nodes, docs, id_col, text, scratch)
    links = confirm_stars(pairs, texts, 5, STAR, scratch)
    scratch.drop(texts)
    return links


def _in_slices(dealt: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs of the blocks dealt (bucket, p, q, side, node, comp), found slice by slice; a block lies in one slice.

    A slice has about ``SLICE`` rows for each class, so the files of its shuffle, which hold a bitmap a row, grow no
    faster than the input, however many rows the blocks have.
    """
    dealt = scratch.save(dealt.withColumn("lot", F.pmod(F.xxhash64("bucket", "p", "q"), F.lit(1 << 20))), "dealt")
    slices = max(1, ceil(dealt.count() / (SLICE * max(1, nodes.count()))))
    bodies = nodes.select("node", "n", "map", F.get("prefix", F.lit(0)).alias("first"))
    found = []
    for k in range(slices):
        rows = dealt.where(F.pmod(F.col("lot"), F.lit(slices)) == k).drop("lot")
        found.append(scratch.save(_traverse(rows.join(bodies.hint("merge"), "node"), forest=False), "slice"))
    pairs = scratch.save(reduce(DataFrame.union, found).distinct(), "pairs")
    for part in [dealt, *found]:
        scratch.drop(part)
    return pairs


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (bucket, node, comp) -> the buckets of several components; of those with the same members one is enough."""
    return (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("s2"))
        .where("c0 <> c1")
        .groupBy("members", "s1", "s2")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the least id that links can reach."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, drop_shuffles=True)
    rows = scratch.save(_sets(docs, id_col, text), "rows")
    usable = rows.where("n > 0 and id is not null")
    nodes = usable.groupBy("f1", "f2", "n").agg(F.min_by(F.struct("id", "th", "prefix", "map"), "id").alias("r"))
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", "r.*"), "nodes")
    facts = scratch.save(rows.select("id", "n", "f1", "f2"), "facts")
    scratch.drop(rows)

    # First round: a forest of what the smallest hashes bring together.
    first = nodes.select(F.explode(F.slice("prefix", 1, FIRST_HASHES)).alias("bucket"), "node", "n", "map", F.get("prefix", F.lit(0)).alias("first"))
    shared = scratch.save(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    met = first.join(shared.hint("merge"), "bucket").withColumns({"comp": F.col("node"), "side": F.lit(2), "parts": F.ceil(F.col("members") / PART)})
    met = met.withColumn("p", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int")).withColumn("q", F.col("p"))
    pairs = scratch.save(_traverse(met, forest=True), "pairs")
    links = _verify(pairs, nodes, docs, scratch, id_col, text)
    scratch.drop(pairs)
    roots = components(links, scratch)

    # Second round: all prefix hashes, between the components of the first.
    inside = nodes.join(roots.hint("merge"), "node", "left").withColumn("comp", F.coalesce("root", "node"))
    tokens = inside.select(F.explode("prefix").alias("bucket"), "node", "comp")
    live = scratch.save(tokens.join(scratch.save(_mixed(tokens), "mixed").hint("merge"), "bucket"), "live")
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    cells = live.join(nodes.select("node", "n").hint("merge"), "node").withColumn("band", F.explode(F.array(band - 1, band)))
    cells = scratch.save(cells.select(F.xxhash64("bucket", "band").alias("bucket"), "node", "comp", F.lit(1).alias("weight")), "cells")
    scratch.drop(live)
    whole, cells = cells, scratch.save(cells.join(scratch.save(_mixed(cells), "mixed").hint("merge"), "bucket"), "cells")
    scratch.drop(whole)
    pairs = _in_slices(blocks(cells, "weight", BUCKET, scratch).select("bucket", "p", "q", "side", "node", "comp"), nodes, scratch)
    scratch.drop(cells)
    more = _verify(pairs, nodes, docs, scratch, id_col, text)
    scratch.drop(pairs)
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))  # connects what the first links do, as stars
    roots = components(known.unionByName(more), scratch)

    named = nodes.select("node", "f1", "f2", "n", "id").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.save(named, "named")
    scratch.drop(nodes)
    least = scratch.save(named.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    classes = scratch.save(named.join(least.hint("merge"), "root").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), "component_id"), "classes")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    joined = facts.join(classes.hint("merge"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
