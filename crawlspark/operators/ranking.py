"""Places in a total order, found without sorting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def _in_ranges(rows: DataFrame, order: Sequence[str | Column], scratch: Scratch) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows in written ranges of the order, sorted, with an id __at; and (range, its first id, its number of rows) of each."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = scratch.save(ranged, "ranged")
    part = F.shiftright("__at", 33)  # the id's upper bits number the partition
    counts = ranged.groupBy(part.alias("part")).agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    return ranged, [tuple(c) for c in counts]


def ranked(rows: DataFrame, order: Sequence[str | Column], scratch: Scratch, name: str = "rank", start: int = 0) -> DataFrame:
    """``rows`` with their places by ``order``, from ``start`` on; equal keys get places of their own in any order.

    Rows are dealt over ranges of the order and sorted within them. What the driver sees is one count per range.
    """
    ranged, ranges = _in_ranges(rows, order, scratch)
    shifts, before = [], start
    for part, first, n in ranges:
        shifts.append((part, before - first))
        before += n
    table = F.broadcast(rows.sparkSession.createDataFrame(shifts, "__part long, __shift long"))
    placed = ranged.withColumn("__part", F.shiftright("__at", 33)).join(table, "__part").withColumn(name, F.col("__at") + F.col("__shift"))
    return placed.select(*rows.columns, name)


def page_of(rows: DataFrame, order: Sequence[str | Column], page: int, size: int, scratch: Scratch) -> DataFrame:
    """The rows of one page (from 1) of a table in a total order.

    Of the written ranges, a page reads those that it lies in, however deep it is: it is found by the ranges' counts.
    """
    ranged, ranges = _in_ranges(rows, order, scratch)
    begin, end, before = (page - 1) * size, page * size, 0
    wanted = F.lit(False)
    for _, first, n in ranges:
        if before < end and before + n > begin:
            wanted = wanted | F.col("__at").between(first + max(begin - before, 0), first + min(end - before, n) - 1)
        before += n
    return ranged.where(wanted).orderBy("__at").drop("__at")
