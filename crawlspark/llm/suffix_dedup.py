"""Removal of byte strings of ``length`` bytes that start more than once in the corpus.

Every string of that length has an anchor that depends on its bytes alone, so equal strings meet in their anchor's
bucket. The strings of one anchor in one document are a window of text. Buckets whose windows are all equal are settled
by counting; what is left are the distinct windows of the other buckets. Tasks put these into run-length indexes of
bounded size (a run-compressed Burrows-Wheeler transform with sampled run ends, see run_index), stream the matching
statistics of every position out of them, and mark the long matches. The marks go back to all windows that are equal,
and documents lose the bytes that the marked strings cover.

An index holds buckets of up to ``INDEX_BYTES``. A passage that a third of all documents share gives larger ones, as
many windows as documents, each with other neighbours. They are divided by the distance of a string's start from the
anchor, which equal strings have in common: a window gives one slice per range of distances, and all strings of a range
hold the same core of bytes, so slices meet by anchor, range and core. Slices inside the passage are equal and settled by
counting, those whose core reaches out of it are alone, and only those that begin or end across its edge meet as before:
they are indexed or divided again, down to single strings, of which a bucket holds but one.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows are equal texts, and
equal texts of at least ``length`` bytes lose everything; rows without an id are treated as any other; an empty table
gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, window_prints
from .arrow import small_batches
from .run_index import repeated_starts
from .scratch import Scratch
from .shingles import BLANK, mix, text_bytes

#: Bytes of an index; its arrays stay in the cache. One bucket may fill an index up to INDEX_BYTES (2 MB is the most it can hold).
SHARD_BYTES, INDEX_BYTES = 1 << 17, 1 << 20
#: Distances from the anchor in a range, in turn, by which a bucket is divided.
RANGES = (32, 1)
#: Letters that stand for a word when repeated passages of words are looked for: 24 bits of its hash, six a letter.
WORD_LETTERS = 4


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """rows: (id, th, text) -> (id, th, h, w, a, b, p): the starts of each anchor and its place; the window's fingerprint is (h, w)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            h, p, a, b = anchors(raw, length, offsets)
            owner = np.searchsorted(offsets, a, side="right") - 1
            begin, row = offsets[owner], pa.array(owner)
            cols = [batch.column(0).take(row), batch.column(1).take(row), *[pa.array(x.view(np.int64)) for x in (h, window_prints(raw, a, b + length))], *[pa.array(x - begin) for x in (a, b, p)]]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", "h", "w", "a", "b", "p"])

    return rows.mapInArrow(build, f"id {id_type}, th long, h long, w long, a long, b long, p long")


def _cut(texts: DataFrame) -> DataFrame:
    """(text, list of wanted windows) -> a row with the bytes of each window and the anchor's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            data, wanted = raw.tobytes(), batch.column(1)
            owner = np.repeat(offsets[:-1], np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            cols = {c: flat.field(c).to_numpy() for c in ("h", "w", "copies", "a", "e", "p")}
            pieces = [data[s:e] for s, e in zip((owner + cols["a"]).tolist(), (owner + cols["e"]).tolist(), strict=True)]
            place = pa.array(cols["p"] - cols["a"])
            yield pa.RecordBatch.from_arrays([*[pa.array(cols[c]) for c in ("h", "w", "copies")], place, pa.array(pieces, pa.binary())], ["h", "w", "copies", "p", "bytes"])

    return texts.mapInArrow(run, "h long, w long, copies long, p long, bytes binary")


def _index(windows: DataFrame, length: int) -> DataFrame:
    """Distinct windows, a bucket's in one partition -> (h, w, lo, hi): runs of starts whose strings repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, (None, None)

        def flush() -> pa.RecordBatch:
            marks = repeated_starts([x[3] for x in held], length)
            lows, highs = [], []
            for x, mark in zip(held, marks, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (mark | (x[2] > 1)).astype(np.int8), [0]])))
                lows.append(edge[::2])
                highs.append(edge[1::2] - 1)
            return pa.RecordBatch.from_arrays(
                [*[pa.array([x[k] for x in held], pa.int64()) for k in range(2)], pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))], ["h", "w", "lo", "hi"]
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] == last:  # rows that repeat an id and its text
                    continue
                if size >= SHARD_BYTES and row[0] != last[0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[:2]
        if held:
            yield flush()

    ordered = windows.repartition("h").sortWithinPartitions("h", "w")
    return ordered.select("h", "w", "copies", "bytes").mapInArrow(run, "h long, w long, lo array<long>, hi array<long>")


def _slices(windows: DataFrame, length: int, width: int) -> DataFrame:
    """Distinct windows -> (h, w, copies, lo, hi, key, s): their starts by ranges of ``width`` distances from the anchor.

    key stands for anchor, range and core, s for the slice's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, copies, p, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = np.frombuffer(data, np.uint8)
                kind = (p - np.arange(len(raw) - length + 1)) // width
                edges = np.flatnonzero(np.diff(kind, prepend=kind[0] + 1, append=kind[-1] - 1))
                lo, hi, kind = edges[:-1], edges[1:] - 1, kind[edges[:-1]]
                core = window_prints(raw, p - kind * width, p - (kind + 1) * width + 1 + length, 77)
                key = mix(core ^ mix(kind.astype(np.uint64) + np.uint64(h % (1 << 64))))
                same = [pa.array(np.full(len(lo), v, dtype=np.int64)) for v in (h, w, copies)]
                prints = [pa.array(x.view(np.int64)) for x in (key, window_prints(raw, lo, hi + length))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(lo), pa.array(hi), *prints], ["h", "w", "copies", "lo", "hi", "key", "s"])

    return windows.select("h", "w", "copies", "p", "bytes").mapInArrow(run, "h long, w long, copies long, lo long, hi long, key long, s long")


def _marks(windows: DataFrame, length: int, scratch: Scratch, ranges: Sequence[int] = RANGES) -> DataFrame:
    """Distinct windows of buckets that have more than one -> (h, w, lo, hi): runs of starts whose strings repeat."""
    size = F.sum(F.octet_length("bytes"))
    large = scratch.save(windows.groupBy("h").agg(size.alias("size")).where(F.col("size") > INDEX_BYTES).select(F.col("h").alias("lh")), "large")
    in_large = F.col("h") == F.col("lh")
    if large.isEmpty():
        scratch.drop(large)
        return _index(windows, length)
    small = _index(windows.join(large.hint("merge"), in_large, "left_anti"), length)
    if not ranges:
        raise ValueError("strings of one fingerprint differ")
    windows = scratch.save(windows.join(large.hint("merge"), in_large, "left_semi").dropDuplicates(["h", "w"]), "divided")
    slices = scratch.save(_slices(windows, length, ranges[0]), "slices")
    distinct = scratch.save(slices.groupBy("key", "s").agg(F.sum("copies").alias("n"), F.min(F.struct("h", "w", "lo", "hi")).alias("at")), "distinct")
    often = distinct.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("c")).where("c > 1").drop("c")
    met = scratch.save(distinct.join(often.hint("merge"), F.col("key") == F.col("k")).drop("k"), "met")
    settled = met.where("kinds = 1").select("key", "s", F.array(F.lit(0).cast("long")).alias("lo"), F.array(F.col("at.hi") - F.col("at.lo")).alias("hi"))
    again = met.where("kinds > 1").select("key", "s", "n", F.col("at.h").alias("ah"), F.col("at.w").alias("aw"), F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))
    again = again.join(windows.hint("merge"), (F.col("ah") == F.col("h")) & (F.col("aw") == F.col("w")))
    part = F.substring("bytes", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + length).cast("int"))
    again = again.select(F.col("key").alias("h"), F.col("s").alias("w"), F.col("n").alias("copies"), (F.col("p") - F.col("lo")).alias("p"), part.alias("bytes"))
    again = scratch.save(again, "again")
    found = _marks(again, length, scratch, ranges[1:]).where(F.size("lo") > 0)
    marks = scratch.save(settled.unionByName(found.withColumnsRenamed({"h": "key", "w": "s"})).withColumnsRenamed({"key": "mk", "s": "ms", "lo": "los", "hi": "his"}), "slice-marks")
    moved = [F.transform(c, lambda x: x + F.col("begin")).alias(n) for c, n in (("los", "lo"), ("his", "hi"))]
    back = slices.withColumnRenamed("lo", "begin").join(marks.hint("merge"), (F.col("key") == F.col("mk")) & (F.col("s") == F.col("ms"))).select("h", "w", *moved)
    back = scratch.save(small.unionByName(back), "divided-marks")
    for used in (windows, slices, distinct, met, again, marks, large):
        scratch.drop(used)
    return back


def _starts(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """rows: (id, th, text) -> (sid, sth, starts): of each text that has any, the runs of starts of repeated strings."""
    windows = scratch.save(_windows(rows, length), "windows")
    mixed = F.min("w") != F.max("w")
    buckets = windows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), mixed.alias("mixed")).where("c > 1").select(F.col("h").alias("bh"), "mixed")
    buckets = scratch.save(buckets, "buckets")
    shared = scratch.save(windows.join(buckets.hint("merge"), F.col("h") == F.col("bh")).drop("bh"), "shared")
    scratch.drop(windows)
    scratch.drop(buckets)

    distinct = shared.where("mixed").groupBy("h", "w").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "th", "a", "b", "p")).alias("at"))
    window = F.struct("h", "w", "copies", F.col("at.a").alias("a"), (F.col("at.b") + length).alias("e"), F.col("at.p").alias("p"))
    wanted = distinct.select(F.col("at.id").alias("wid"), F.col("at.th").alias("wth"), window.alias("w"))
    wanted = scratch.save(wanted.groupBy("wid", "wth").agg(F.collect_list("w").alias("ws")), "wanted")
    texts = rows.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    cut = scratch.save(_cut(texts.select("text", "ws")), "cut")
    scratch.drop(wanted)
    marks = _marks(cut, length, scratch).where(F.size("lo") > 0)
    marks = scratch.save(marks.withColumnsRenamed({"h": "mh", "w": "mw"}), "marks")
    scratch.drop(cut)

    marked = shared.where("mixed").join(marks.hint("merge"), (F.col("h") == F.col("mh")) & (F.col("w") == F.col("mw")))
    moved = F.transform(F.arrays_zip("lo", "hi"), lambda r: F.struct((F.col("a") + r["lo"]).alias("a"), (F.col("a") + r["hi"]).alias("b")))
    runs = marked.select("id", "th", F.explode(moved).alias("r"))
    runs = runs.unionByName(shared.where("not mixed").select("id", "th", F.struct("a", "b").alias("r")))
    starts = runs.groupBy(F.col("id").alias("sid"), F.col("th").alias("sth")).agg(F.collect_set("r").alias("starts"))
    starts = scratch.save(starts, f"starts-{length}")
    scratch.drop(shared)
    scratch.drop(marks)
    return starts


def word_codes(texts: pa.Array) -> pa.Array:
    """Each text with WORD_LETTERS letters for every word, and nothing between them."""
    raw, offsets = text_bytes(texts)
    solid = np.concatenate([[False], ~BLANK[raw], [False]])
    inner = offsets[1:-1]
    breaks = np.zeros(len(solid), dtype=bool)  # a word ends where its text does
    breaks[inner + 1] = True
    begins = np.flatnonzero(solid[1:-1] & (~solid[:-2] | breaks[1:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | breaks[2:])) + 1
    hashes = np.where(ends - begins > 1, window_prints(raw, begins, ends), mix(raw[begins].astype(np.uint64)))
    letters = np.stack([((hashes >> np.uint64(6 * k)) & np.uint64(63)).astype(np.uint8) for k in range(WORD_LETTERS)], axis=1)
    first = np.searchsorted(begins, offsets) * WORD_LETTERS
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(letters.tobytes())])


def _coded(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), word_codes(batch.column(2)).cast(pa.string())], ["id", "th", "text"])

    return rows.mapInArrow(run, rows.schema)


def _covered(starts: pa.Scalar, length: int, unit: int = 1) -> np.ndarray:
    """Begins and ends of the runs that the strings cover, in units; a string counts that starts with a unit."""
    if not starts.is_valid or not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    first, last = -(-starts.values.field("a").to_numpy() // unit), starts.values.field("b").to_numpy() // unit
    first, last = first[whole := first <= last], last[whole]
    steps = np.zeros(int(last.max(initial=0)) + length + 2, dtype=np.int32)
    np.add.at(steps, first + 1, 1)
    np.add.at(steps, last + length + 1, -1)
    return np.flatnonzero(np.diff((np.cumsum(steps) > 0).astype(np.int8))).reshape(-1, 2)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400, passage: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, kept (the remaining bytes), n_bytes, n_removed and spans (array of begin, end).

    passage: a number of words adds n_passages, the number of spans of words that strings of so many words cover which
    start more than once, whatever stands between words. Such a span may have fewer bytes than ``length``: it is reported,
    not removed. Words are compared by 24 bits of a hash, so strings that differ in one word are taken as equal
    in one of 16 million cases.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth"))
    starts = _starts(rows, length, scratch).withColumn("short", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    if passage:
        short = _starts(_coded(rows), passage * WORD_LETTERS, scratch).withColumnsRenamed({"sid": "tid", "sth": "tth", "starts": "short"})
        both = starts.drop("short").join(short.hint("merge"), F.col("sid").eqNullSafe(F.col("tid")) & (F.col("sth") == F.col("tth")), "full")
        starts = scratch.save(both.select(F.coalesce("sid", "tid").alias("sid"), F.coalesce("sth", "tth").alias("sth"), "starts", "short"), "starts")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            kept, spans, removed, passages = [], [], [], []
            for lo, hi, long, short in zip(offsets[:-1], offsets[1:], batch.column(2), batch.column(3), strict=True):
                body, found = raw[lo:hi], _covered(long, length)
                cuts = np.concatenate([[0], found.ravel(), [hi - lo]])
                kept.append(b"".join(body[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                spans.append([{"begin": a, "end": b} for a, b in found.tolist()])
                removed.append(int((found[:, 1] - found[:, 0]).sum()))
                passages.append(len(_covered(short, passage, WORD_LETTERS)) if passage else 0)
            cols = [batch.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "kept", "n_bytes", "n_removed", "spans", "n_passages"])

    joined = rows.join(starts.hint("merge"), same, "left")
    id_type = docs.schema[id_col].dataType.simpleString()
    out = joined.select("id", "text", "starts", "short").mapInArrow(remove, f"`{id_col}` {id_type}, kept binary, n_bytes long, n_removed long, spans array<struct<begin:bigint,end:bigint>>, n_passages long")
    return out if passage else out.drop("n_passages")
