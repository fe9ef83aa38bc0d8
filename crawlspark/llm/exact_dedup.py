"""Exact duplicates by distributed MSD radix partitioning.

Texts are split into groups by successive bytes of their UTF-8 form: first by the first 64 bytes, then each group by
the next 1,024, then by the next 16,384 and so on, until a group has one member or its texts have ended. Two texts are
in one group at the end if and only if all their bytes are equal; no digest decides. Each level is one aggregation
with partial sums (group, next bytes -> count, largest id) and one left join that tells the rows which group they are
in; the groups are a written table by then, so that a hot group's rows can be split over tasks. Only rows whose group
goes on are carried to the next level, with the rest of their bytes.

Defined results: null counts as an empty text; an empty table gives an empty table; repeated rows are equal texts, and
each of them that has the largest id is kept; a null id is smaller than any other. Columns other than those named in
``carry`` are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

FIRST_BYTES, WIDEN = 64, 16


def _split_level(rows: DataFrame, scratch: Scratch, width: int, id_col: str, carry: Sequence[str]) -> DataFrame:
    """One level: rows (id, carry, __group, __rest) -> rows with keep_id and group_size, or with a new group and rest."""
    piece = F.substring("__rest", 1, width).alias("__piece")
    ended = (F.octet_length("__rest") <= width).alias("__ended")
    keyed = rows.select(id_col, *carry, "__group", piece, ended, F.substring("__rest", width + 1, 2**31 - 1).alias("__rest"))
    sizes = (
        rows.select(F.col(id_col).alias("__id"), "__group", piece, ended)
        .groupBy("__group", "__piece", "__ended")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__max"))
        .where("__n > 1")
        .withColumn("__next", F.monotonically_increasing_id())
    )
    groups = scratch.save(sizes, "groups").withColumnsRenamed({c: f"{c}_g" for c in ("__group", "__piece", "__ended")})
    on = [keyed[c] == groups[f"{c}_g"] for c in ("__group", "__piece", "__ended")]
    goes_on = F.col("__next").isNotNull() & ~F.col("__ended")
    # Merged by shuffle at every size: the groups grow with the input, and a broadcast of them would stop fitting.
    return keyed.join(groups.hint("merge"), on, "left").select(
        id_col,
        *carry,
        F.when(~goes_on, F.when(F.col("__next").isNotNull(), F.col("__max")).otherwise(F.col(id_col))).alias("keep_id"),
        F.when(~goes_on, F.coalesce("__n", F.lit(1).cast("long"))).alias("group_size"),
        F.when(goes_on, F.col("__next")).alias("__group"),
        F.when(goes_on, F.col("__rest")).alias("__rest"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``carry``, keep_id (the group's largest id), group_size and kept."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(id_col, *carry, F.lit(0).cast("long").alias("__group"), F.coalesce(text, F.lit("")).cast("binary").alias("__rest"))
    width, done, level = FIRST_BYTES, [], None
    while level is None or not rows.isEmpty():
        level = scratch.save(_split_level(rows, scratch, width, id_col, carry), "level")
        done.append(level.where("__group is null").drop("__group", "__rest"))
        rows = level.where("__group is not null").drop("keep_id", "group_size")
        width *= WIDEN
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
