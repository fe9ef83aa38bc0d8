"""Merkle manifests: a digest of every row, a tree of digests for each group, and one tree over the groups.

Rows of a group are leaves in a given order. While a tree has several nodes, every ``arity`` consecutive ones (a run; the
last may be shorter, even of one) become their digest, up to the group's subroot; the subroots, in the order of their
groups, form one more tree, whose top is the root.

1. Leaves are sorted by (group, order) over ranges, so that a group of any size lies in several partitions. A leaf's place
   in its group is its place in the partition plus the leaves of the group in earlier partitions, which are counted in
   a table of one row per group and partition.
2. At every level the rows of slot zero ask for the siblings of their run by computed index (place + offset), an equijoin
   of the level with itself, and emit the parent. All groups climb together; a tree that has one node leaves the loop.
3. Down again, each run takes over the path that its parent has: a join of the level's runs with those above, an eighth
   of them. Only the last join has as many rows as there are leaves. A path is one (before, after) pair of sibling
   digests per level.

Defined results: a null field counts as ``-``, an empty one as ``0:``; the null group comes first; null ids come before
others; rows of the same group and id are leaves of their own, ordered by digest, and equal rows are interchangeable;
an empty table gives an empty table; columns that aren't named in ``carry`` are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

ARITY = 8
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column | str) -> Column:
    """Lower-case hex SHA-256 of the strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column | str) -> Column:
    """The digest of a row's fields; each is ``-`` if null, else its number of UTF-8 bytes, a colon and its text."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _placed(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """rows with __tree -> with __place in the tree (from 0, by ``order``) and __size of the tree."""
    ranged = rows.repartitionByRange("__tree", *order).sortWithinPartitions("__tree", *order)
    ranged = scratch.save(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__at", 33)  # the id's upper bits number the partition
    counts = ranged.groupBy("__tree", part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    tree, earlier = Window.partitionBy("__tree"), Window.partitionBy("__tree").orderBy("__part")
    starts = counts.select("__tree", "__part", (F.sum("__n").over(earlier) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("__size"))
    starts = scratch.save(starts, "starts")  # of known size: small enough, Spark broadcasts it, else it is shuffled
    return ranged.withColumn("__part", part).join(starts, ["__tree", "__part"]).withColumn("__place", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _climb(nodes: DataFrame, arity: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """nodes (__tree, __place, __size, __digest) -> (the runs of each level, the tops (__tree, __top))."""
    levels = []
    tops = nodes.where("__size = 1").select("__tree", F.col("__digest").alias("__top"))
    largest = nodes.agg(F.max("__size")).first()[0] or 0
    while largest > 1:
        zero = nodes.where((F.col("__size") > 1) & (F.col("__place") % arity == 0))
        offsets = F.sequence(F.lit(0), F.least(F.lit(arity), F.col("__size") - F.col("__place")).cast("int") - 1)
        asks = zero.select("__tree", (F.col("__place") / arity).cast("long").alias("__run"), F.ceil(F.col("__size") / arity).alias("__above"), "__place", F.explode(offsets).alias("__slot"))
        asks = asks.withColumn("__place", F.col("__place") + F.col("__slot"))
        met = asks.join(nodes.select("__tree", "__place", "__digest").hint("merge"), ["__tree", "__place"])
        runs = met.groupBy("__tree", "__run").agg(F.first("__above").alias("__size"), F.array_sort(F.collect_list(F.struct("__slot", "__digest"))).alias("__met"))
        runs = scratch.save(runs.select("__tree", "__run", "__size", F.col("__met.__digest").alias("__digests")), "runs")
        levels.append(runs)
        nodes = runs.select("__tree", F.col("__run").alias("__place"), "__size", F.sha2(F.array_join("__digests", "").cast("binary"), 256).alias("__digest"))
        tops = tops.unionByName(nodes.where("__size = 1").select("__tree", F.col("__digest").alias("__top")))
        largest = -(-largest // arity)
    return levels, tops


def _descend(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """leaves (__tree, __place, __size, ...) with __path up to the top of ``above`` (__tree, __path)."""

    def step(nodes: DataFrame, place: str, upper: DataFrame | None) -> DataFrame:
        out = nodes.where("__size = 1").join(above, "__tree")
        if upper is None:
            return out
        slot = (F.col(place) % arity).cast("int")
        runs = upper.select(F.col("__tree").alias("__upper_tree"), F.col("__run").alias("__upper_run"), F.col("__digests").alias("__run_digests"), F.col("__path").alias("__upper_path"))
        met = nodes.where("__size > 1").withColumn("__parent", (F.col(place) / arity).cast("long"))
        met = met.join(runs.hint("merge"), (F.col("__tree") == F.col("__upper_tree")) & (F.col("__parent") == F.col("__upper_run")))
        before = F.array_join(F.slice("__run_digests", F.lit(1), slot), "")
        after = F.array_join(F.slice("__run_digests", slot + 2, F.lit(arity)), "")
        path = F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), F.col("__upper_path"))
        return out.unionByName(met.select(*nodes.columns, path.cast(_PATH).alias("__path")))

    upper = None
    for runs in reversed(levels):
        upper = step(runs, "__run", upper)
    return step(leaves, "__place", upper)


def merkle_paths(leaves: DataFrame, group: str | Column, order: Sequence[str], leaf: str = "leaf", carry: Sequence[str] = (), arity: int = ARITY) -> DataFrame:
    """One row per row of ``leaves``: ``carry``, ``leaf``, subroot, root and path, sibling digests from its run up to the root."""
    scratch = Scratch(leaves.sparkSession)
    group = F.col(group) if isinstance(group, str) else group
    tree = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))  # sorts null first, then by bytes
    keys = {f"__order{i}": F.col(c) for i, c in enumerate(order)}
    rows = leaves.select(*carry, F.col(leaf).alias("__digest"), tree.alias("__tree"), *[c.alias(k) for k, c in keys.items()], F.monotonically_increasing_id().alias("__row"))
    rows = scratch.save(rows, "leaves")
    placed = scratch.save(_placed(rows, [*keys, "__digest", "__row"], scratch).drop(*keys, "__row"), "placed")
    levels, tops = _climb(placed.select("__tree", "__place", "__size", "__digest"), arity, scratch)

    subroots = tops.select(F.col("__tree").alias("__group"), F.col("__top").alias("__digest"), F.lit("").alias("__tree"))
    subroots = scratch.save(_placed(subroots, ["__group"], scratch), "subroots")
    top_levels, root = _climb(subroots.select("__tree", "__place", "__size", "__digest"), arity, scratch)
    above = _descend(subroots, top_levels, root.select("__tree", F.array().cast(_PATH).alias("__path")), arity)
    above = above.crossJoin(F.broadcast(root.select(F.col("__top").alias("__root"))))  # the root is one row
    above = scratch.save(above.select(F.col("__group").alias("__tree"), F.col("__digest").alias("__subroot"), "__root", "__path"), "above")

    out = _descend(placed, levels, above.select("__tree", "__path"), arity)
    out = out.join(above.drop("__path"), "__tree")
    return out.select(*carry, F.col("__digest").alias("leaf"), F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), F.col("__path").alias("path"))


def proof_digest(path: str | Column = "path") -> Column:
    """The digest of all sibling digests of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: str | Column, path: str | Column = "path") -> Column:
    """The root that a leaf gives with the siblings of its path."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256))
