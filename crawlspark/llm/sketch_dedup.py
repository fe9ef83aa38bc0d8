"""Near duplicates by fast similarity sketching: link documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. Every whole text becomes its set of shingle hashes and a sketch of ``COORDINATES`` places. In round r each element
   falls into one place by its hash of that round; an empty place takes the least hash that falls into it, a filled one
   stays. After ``COORDINATES`` rounds, round r puts all elements into place r - ``COORDINATES``, so every place is
   filled in the end. Large sets are done after a round or two, so a sketch costs about one hash per element, while the
   share of equal places concentrates about the similarity as for independent hashes.
2. Equal sets are one class with one representative. ``ROWS`` places in a row are a band; classes with an equal band
   share its bucket. Two sets of similarity 0.8 share none of 32 bands of 4 with a chance of (1 - 0.8^4)^32 = 5e-8.
3. First pass: each class is compared with one leader, the least class of a bucket that it shares most buckets with.
   Links are confirmed on full sets, centre by centre, and joined to components.
4. Second pass: buckets that still hold several components. Their largest component is dealt over blocks and compared
   with the others only, the others also with each other, never within a component. Blocks of sketches first tell which
   classes have any partner of another component with at least ``LEAST_EQUAL`` equal places (similarity 0.8 has fewer
   with a chance below 1e-9); then blocks of full texts confirm links. A block emits ids of classes or the links of a
   forest, never its pairs, and rows of a large bucket lie in several blocks of bounded size.

Defined results: null and empty texts have no shingles and no links; a text of fewer words than a shingle is one shingle;
rows without an id are in no group, get a null component and are kept; repeated rows are copies of one class; an empty
table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .blocks import blocks, confirm_stars, each_block, linked, texts_of
from .components import components
from .scratch import Scratch
from .shingles import mix, shingle_sets

COORDINATES, ROWS = 128, 4
LEAST_EQUAL = 72
#: A block's texts have about this many words, and a class counts as LIGHTEST of them at least: so it has 4,096 classes at most.
BLOCK, LIGHTEST = 1 << 20, 256
#: Members of a star that one task compares with its centre.
STAR = 512


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """(len(sets), t) coordinates; t is a power of two. Empty sets have zeros."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    out, filled = np.full(len(sets) * t, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(len(sets) * t, dtype=bool)
    seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) << np.uint64(20))
    for r in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ seeds[r])
        place = owner * t + ((h & np.uint64(t - 1)).astype(np.int64) if r < t else r - t)
        empty = ~filled[place]
        place = place[empty]
        np.minimum.at(out, place, h[empty])
        filled[place] = True
        goes_on = ~filled.reshape(-1, t).all(axis=1)[owner]
        x, owner = x[goes_on], owner[goes_on]
    return np.where(filled, out, np.uint64(0)).reshape(-1, t)


def _bands(sketch: np.ndarray) -> np.ndarray:
    """(rows, bands) hashes; equal bands at different places differ."""
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    by_band = (sketch.reshape(len(sketch), -1, ROWS) * weights).sum(axis=2, dtype=np.uint64)
    return mix(by_band + mix(np.arange(7, 7 + by_band.shape[1], dtype=np.uint64))).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(id, th, n, f1, f2, bands, places) of each row; f1 and f2 are the fingerprint of the set, places a byte of each coordinate."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            prints = [[int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for k in (0x2E1, 0xB7B7B7)]
            sketch = sketches(sets)
            bands = pa.array([b if m else None for b, m in zip(_bands(sketch), n, strict=True)], pa.list_(pa.int64()))
            places = pa.array([p.tobytes() for p in (mix(sketch) & np.uint64(255)).astype(np.uint8)], pa.binary())
            cols = [batch.column(0), batch.column(1), pa.array(n), *[pa.array(p, pa.int64()) for p in prints], bands, places]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", "n", "f1", "f2", "bands", "places"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text)
    return rows.mapInArrow(build, f"id {id_type}, th long, n long, f1 long, f2 long, bands array<long>, places binary")


def _alike(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, equal places) of the pairs of a block that may be linked and are in different components."""
    n, comp, side = (block[c].to_numpy() for c in ("n", "comp", "side"))
    places = np.frombuffer(b"".join(block["places"].to_pylist()), dtype=np.uint8).reshape(len(n), -1)
    among = side[0] == 2
    left, right = (np.arange(len(n)),) * 2 if among else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for a in range(0, len(left), 64):
        i = left[a : a + 64]
        ok = (comp[i][:, None] != comp[right]) & (5 * np.minimum(n[i][:, None], n[right]) >= 4 * np.maximum(n[i][:, None], n[right]))
        if among:
            ok &= i[:, None] < right
        x, y = np.nonzero(ok)
        for b in range(0, len(x), 1 << 18):
            u, v = i[x[b : b + (1 << 18)]], right[y[b : b + (1 << 18)]]
            equal = (places[u] == places[v]).sum(axis=1)
            yield u[equal >= LEAST_EQUAL], v[equal >= LEAST_EQUAL], equal[equal >= LEAST_EQUAL]


def _with_partner(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The (bucket, node) of rows (bucket, node, comp, n, places) that may be linked with another component of the bucket."""

    def work(block: pa.Table) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(block.num_rows, dtype=bool)
        for i, j, _ in _alike(block):
            hit[i] = hit[j] = True
        found = block.select(["bucket", "node"]).filter(pa.array(hit)).combine_chunks()
        yield from found.to_batches()

    dealt = blocks(rows.withColumn("weight", F.lit(LIGHTEST)), "weight", BLOCK, scratch).repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "node")
    found = dealt.select("bucket", "p", "q", "side", "node", "comp", "n", "places").mapInArrow(lambda batches: each_block(batches, work), "bucket long, node long")
    return scratch.save(found.distinct(), "partners")


def _confirm_blocks(rows: DataFrame, texts: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """rows (bucket, node, comp, n, places) -> (u, v), a forest of confirmed links for each block."""

    def work(block: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp = block["node"].to_numpy(), block["comp"].to_numpy()
        sets = shingle_sets(block["text"].combine_chunks(), words)
        parent = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = []
        for i, j, equal in _alike(block):
            for k in np.argsort(-equal, kind="stable"):
                a, b = root(int(comp[i[k]])), root(int(comp[j[k]]))
                if a != b and linked(sets[i[k]], sets[j[k]]):
                    parent[b] = a
                    links.append((int(node[i[k]]), int(node[j[k]])))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])

    dealt = blocks(rows.withColumn("weight", F.greatest("n", F.lit(LIGHTEST))), "weight", BLOCK, scratch).drop("weight")
    dealt = dealt.join(texts.hint("merge"), "node").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "node")
    found = dealt.select("bucket", "p", "q", "side", "node", "comp", "n", "places", "text").mapInArrow(lambda batches: each_block(batches, work), "u long, v long")
    return scratch.save(found, "links")


def sketch_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id that links can reach) and kept."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(_rows(docs, id_col, text, words), "rows")
    usable = rows.where("n > 0 and id is not null")
    nodes = usable.groupBy("f1", "f2", "n").agg(F.min_by(F.struct("id", "th", "bands", "places"), "id").alias("r"))
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", "r.*"), "nodes")
    facts = rows.select("id", "n", "f1", "f2")

    banded = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = scratch.save(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("lead")).where("members > 1"), "shared")
    met = scratch.save(banded.join(shared.select("bucket", "lead").hint("merge"), "bucket"), "met")
    texts = texts_of(met.select("node").distinct(), nodes, docs, id_col, text, scratch)

    together = met.where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("times"))
    stars = scratch.save(together.groupBy("node").agg(F.max_by("lead", F.struct("times", -F.col("lead"))).alias("lead")), "chosen")
    links = confirm_stars(stars, texts, words, STAR, scratch)
    roots = components(links, scratch)

    inside = met.select("bucket", "node").join(roots.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    # Of buckets with the same members one is enough.
    mixed = (
        inside.groupBy("bucket")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("s2"))
        .where("c0 <> c1")
        .groupBy("members", "s1", "s2")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )
    live = inside.join(scratch.save(mixed, "mixed").hint("merge"), "bucket")
    live = scratch.save(live.join(nodes.select("node", "n", "places").hint("merge"), "node").select("bucket", "node", "comp", "n", "places"), "live")
    partners = _with_partner(live, scratch)
    more = _confirm_blocks(live.join(partners.hint("merge"), ["bucket", "node"]), texts, words, scratch)
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(known.unionByName(more), scratch)

    named = scratch.save(nodes.select("node", "f1", "f2", "n", "id").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    least = scratch.save(named.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    classes = scratch.save(named.join(least.hint("merge"), "root").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), "component_id"), "classes")
    joined = facts.join(classes.hint("merge"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")), "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
