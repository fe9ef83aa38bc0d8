"""Exact top-k inner products, vectors in order of descending length, with SVD-rotated partial sums.

Candidates are sorted by length over the cluster and stored in blocks. The rotation comes from the eigenvectors of the
d x d Gram matrix, which tasks add up: it moves most of every vector's length into the first coordinates. A query
needs the blocks whose longest vector could still reach its k-th best score among the longest candidates
(Cauchy-Schwarz); within a block, tiles are taken in order of descending length, and the scan ends at the first tile
that is too short for all queries. What is left is pruned by the sum over the first ``head`` rotated coordinates plus
the product of the lengths of the rest, and only survivors get the exact integer product.

Query blocks meet candidate blocks by an equality join on the block number, so every query is held against all
candidates that it needs, in blocks, and a worker holds one block of each. A block of candidates has up to 65,536 vectors
in the narrowest integers that hold them, so that a query travels once for so many candidates; a block is prepared once
for all query blocks that meet it. The driver knows the blocks by partition, as many rows as there are shuffle partitions.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors are filled up with zeros; rows that share the query's id are the query's own; repeated candidate rows
are candidates each; repeated query rows give one result, and query rows with one id and different vectors give one
each, under the same query_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CANDIDATE_BLOCK, QUERY_BLOCK, TILE = 65536, 512, 1024
#: A block of candidates has fewer vectors if they are so long that it would have more components than this.
BLOCK_VALUES = 1 << 22
#: The longest vectors that give every query its first floor.
FIRST = 8192


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, norm) of the rows that take part; v = floor(scale * x), x as double."""
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), dtype=np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _narrowest(largest: int) -> type:
    """The smallest integer type for components up to ``largest`` in size."""
    return next((t for t in (np.int16, np.int32) if largest <= np.iinfo(t).max), np.int64)


def _blocks(rows: DataFrame, dim: int, size: int, kind: type, name: str) -> DataFrame:
    """Consecutive rows of each partition as blocks (ids and matrix as bytes); the longest vector's length goes along."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, norms = [], [], []

        def flush() -> pa.RecordBatch:
            i, v, n = np.concatenate(ids), np.concatenate(vs), np.concatenate(norms)
            ids.clear(), vs.clear(), norms.clear()
            return pa.RecordBatch.from_arrays([pa.array([float(n.max())]), pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["longest", "ids", "vs"])

        held = 0
        for batch in batches:
            i, v, n = batch.column(0).to_numpy(), _matrix(batch.column(1), dim).astype(kind), batch.column(2).to_numpy()
            for at in range(0, len(i), size):
                if held and held + len(i[at : at + size]) > size:
                    yield flush()
                    held = 0
                ids.append(i[at : at + size]), vs.append(v[at : at + size]), norms.append(n[at : at + size])
                held += len(ids[-1])
        if held:
            yield flush()

    return rows.mapInArrow(build, "longest double, ids binary, vs binary").withColumn(name, F.monotonically_increasing_id())


def rotation_of(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the whole matrix, by descending singular value."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = _matrix(batch.column(0), dim).astype(np.float64)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "s"])

    sums = rows.select("v").mapInArrow(gram, "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    flat = sums.orderBy("at").toPandas()["s"].to_numpy()
    return np.linalg.eigh(flat.reshape(dim, dim))[1][:, ::-1].copy()


def best_of(row: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each row, by score descending, then id."""
    order = np.lexsort((id_, -score, row))
    sorted_rows = row[order]
    first = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - first < k]


def _exact_kind(longest: float) -> type:
    """The fastest type in which sums of integer products up to ``longest`` are exact."""
    return np.float32 if longest < 1 << 23 else np.float64 if longest < 1 << 52 else np.int64


class Prepared(NamedTuple):
    """Vectors with what the search needs of them: lengths, first rotated coordinates, lengths of the rest, order by length."""

    ids: np.ndarray
    exact: np.ndarray
    norm: np.ndarray
    head: np.ndarray
    rest: np.ndarray
    by_length: np.ndarray


def prepared(ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, head: int) -> Prepared:
    turned = v.astype(np.float64) @ rotation
    norm = np.linalg.norm(turned, axis=1)
    rest = np.linalg.norm(turned[:, head:], axis=1).astype(np.float32)
    return Prepared(ids, v, norm, turned[:, :head].astype(np.float32), rest, np.argsort(-norm, kind="stable"))


def search_block(queries: Prepared, among: Prepared, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score): the k best of each query among the candidates, leaving out scores below ``floor``.

    Pairs that the partial sums leave are multiplied out one by one if they are few, else as whole tiles.
    """
    q_ids, q, q_norm, q_head, q_rest, _ = queries
    x_ids, x, x_norm, x_head, x_rest, by_length = among
    kind = _exact_kind(q_norm.max(initial=0) * x_norm.max(initial=0))
    q_full = q.astype(kind)
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = floor.copy()
    for at in range(0, len(x), TILE):
        tile = by_length[at : at + TILE]
        slack = 1e-5 * q_norm * x_norm[tile[0]] + 1e-3
        live = np.flatnonzero(q_norm * x_norm[tile[0]] + slack >= floor)
        if not len(live):
            break
        low = (floor - slack)[live, None].astype(np.float32)
        bound = q_head[live] @ x_head[tile].T
        bound += np.outer(q_rest[live], x_rest[tile])
        left = bound >= low
        if left.mean() > 0.02:
            product = q_full[live] @ x[tile].astype(kind).T
            left &= product >= floor[live, None]
            i, j = np.nonzero(left)
            exact = product[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(left)
            exact = np.concatenate([np.einsum("ij,ij->i", q[live[i[a : a + 65536]]].astype(np.int64), x[tile[j[a : a + 65536]]].astype(np.int64)) for a in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        i, j = live[i], tile[j]
        kept = (q_ids[i] != x_ids[j]) & (exact >= floor[i])
        i, j, exact = i[kept], j[kept], exact[kept]
        if not len(i):
            continue
        rows, ids, scores = np.concatenate([rows, i]), np.concatenate([ids, x_ids[j]]), np.concatenate([scores, exact])
        keep = best_of(rows, scores, ids, k)
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        full = np.flatnonzero(np.bincount(rows, minlength=len(q)) >= k)
        worst = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(worst, rows, scores)
        floor[full] = np.maximum(floor[full], worst[full])
    return rows, ids, scores


def top_k_inner_product(vectors: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = 64, head: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query, ties to the smaller id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(quantised(vectors, id_col, vec_col, scale), "rows")
    size = F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))
    dim, largest = rows.agg(F.max(F.size("v")), F.max(size)).first()
    dim, kind = max(dim or 1, 1), _narrowest(largest or 0)
    longest = rows.orderBy(F.desc("norm"), "id").limit(FIRST).select("id", "v").toPandas()
    if longest.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = rotation_of(rows, dim)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    at_once = min(CANDIDATE_BLOCK, max(TILE, BLOCK_VALUES // dim))
    candidates = _blocks(rows.repartitionByRange(int(parts), F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id"), dim, at_once, kind, "block")
    candidates = scratch.save(candidates.withColumnsRenamed({"ids": "x_ids", "vs": "xs"}), "candidates")
    # Blocks are numbered by partition (the upper bits), from 0 in each.
    reach = candidates.groupBy(F.shiftright("block", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("longest").alias("longest")).collect()

    queries = rows.where(is_query(F.col("id"))).dropDuplicates(["id", "v"])
    queries = scratch.save(_blocks(queries, dim, QUERY_BLOCK, kind, "queries"), "queries")
    top = np.zeros((len(longest), dim), dtype=np.int64)
    for i, v in enumerate(longest["v"]):
        top[i, : len(v)] = v
    top_ids = longest["id"].to_numpy(np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = prepared(top_ids, top, rotation, head)
        for batch in batches:
            floors, needed = [], []
            for ids, vs in zip(batch.column(1), batch.column(2), strict=True):
                q = prepared(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vs.as_buffer(), kind).reshape(-1, dim), rotation, head)
                low = np.full(len(q.ids), -np.inf)
                row, _, score = search_block(q, first, low, k)
                n, worst = np.bincount(row, minlength=len(low)), np.full(len(low), np.iinfo(np.int64).max)
                np.minimum.at(worst, row, score)
                low[n >= k] = worst[n >= k]
                # Cauchy-Schwarz: a candidate of at least this length may reach the floor of one of the queries.
                with np.errstate(divide="ignore", invalid="ignore"):
                    length = np.where(q.norm > 0, (low - 1e-6) / (q.norm * (1 + 1e-9)), np.where(low > 0, np.inf, -np.inf))
                floors.append(low.tobytes())
                needed.append(float(length.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary()), pa.array(needed, pa.float64())], ["queries", "q_ids", "qs", "floors", "needed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, among = None, None
        for batch in batches:
            for number, ids, qs, floors, block, x_ids, xs in zip(*batch.columns, strict=True):
                if held != block.as_py():
                    held, among = block.as_py(), prepared(np.frombuffer(x_ids.as_buffer(), np.int64), np.frombuffer(xs.as_buffer(), kind).reshape(-1, dim), rotation, head)
                q = prepared(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(qs.as_buffer(), kind).reshape(-1, dim), rotation, head)
                row, id_, score = search_block(q, among, np.frombuffer(floors.as_buffer(), np.float64), k)
                yield pa.RecordBatch.from_arrays([pa.array(number.as_py() * QUERY_BLOCK + row), pa.array(q.ids[row]), pa.array(id_), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    routed = queries.select("queries", "ids", "vs").mapInArrow(route, "queries long, q_ids binary, qs binary, floors binary, needed double")
    ranges = F.array(*[F.struct(F.lit(r["part"]).alias("part"), F.lit(r["n"]).alias("n"), F.lit(r["longest"]).alias("longest")) for r in reach])
    wanted = routed.withColumn("r", F.explode(F.filter(ranges, lambda r: r["longest"] >= F.col("needed"))))
    first_block = F.shiftleft(F.col("r.part").cast("long"), 33)
    wanted = wanted.withColumn("block", F.explode(F.sequence(first_block, first_block + F.col("r.n") - 1)))
    pairs = wanted.join(candidates.hint("merge"), "block").where("longest >= needed")
    found = pairs.select("queries", "q_ids", "qs", "floors", "block", "x_ids", "xs").mapInArrow(search, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scratch.save(found, "found").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
