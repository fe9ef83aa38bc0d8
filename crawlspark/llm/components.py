"""Connected components of a table of edges, by alternating large-star and small-star steps.

Every size takes the same steps, and their joins are merged by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """Joins every node's neighbours to the least of them; only minima are aggregated, never lists of neighbours."""
    directed = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch.save(directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    met = directed.join(least.withColumnRenamed("u", "n").hint("merge"), F.col("u") == F.col("n"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return scratch.save(out, "edges")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) edges of long ids -> (node, root) of every node that isn't its component's least; root is the least."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = scratch.save(edges, "edges"), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        edges = _star(_star(edges, scratch, large=True), scratch, large=False)
