"""ZIP files of any size, written by tasks.

Tasks deflate their rows and write pieces of local headers and data; sums over the pieces give every member's offset; tasks
write the central directory, again in pieces. The pieces, one after the other, are the ZIP file: ``join_pieces`` makes
it one, and nothing but names and sizes of pieces passes the driver. A piece is named by its attempt, and only those
count that the written index names, so a task that runs twice does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, _file

#: Fixed values of the format: signatures, the version that is needed, the flag of UTF-8 names, and the first day of its calendar.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
VERSION, UTF8, DEFLATED, DATE = 45, 0x800, 8, 33
FULL = 0xFFFFFFFF
INDEX = "piece string, at long, name string, crc long, packed long, plain long"


def _member(name: bytes, data: bytes) -> tuple[bytes, int, int]:
    """(local header and packed data, CRC, packed size)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed, crc = packer.compress(data) + packer.flush(), zlib.crc32(data)
    if len(packed) >= FULL or len(data) >= FULL:
        raise ValueError(f"{name.decode()} has 4 GB or more")
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATED, 0, DATE, crc, len(packed), len(data), len(name), 0) + name + packed, crc, len(packed)


def _entry(name: bytes, crc: int, packed: int, plain: int, offset: int, zip64_from: int) -> bytes:
    """A member's entry in the central directory; a large offset is in its extra field."""
    far = offset >= zip64_from
    extra = struct.pack("<HHQ", 1, 8, offset) if far else b""
    fields = (CENTRAL, VERSION, VERSION, UTF8, DEFLATED, 0, DATE, crc, packed, plain, len(name), len(extra), 0, 0, 0, 0, FULL if far else offset)
    return struct.pack("<IHHHHHHIIIHHHHHII", *fields) + name + extra


def _tail(members: int, size: int, offset: int, zip64_from: int) -> bytes:
    """What ends the file; where counts or offsets are large, in the larger form first."""
    out = b""
    if members >= 0xFFFF or size >= zip64_from or offset >= zip64_from:
        out = struct.pack("<IQHHIIQQQQ", END64, 44, VERSION, VERSION, 0, 0, members, members, size, offset) + struct.pack("<IIQI", LOCATOR64, 0, offset + size, 1)
        members, size, offset = 0xFFFF, FULL, FULL
    return out + struct.pack("<IHHHHIIH", END, 0, 0, members, members, size, offset, 0)


def write_zip_pieces(rows: DataFrame, folder: str, name: str = "path", data: str = "html", zip64_from: int = FULL) -> list[tuple[str, int]]:
    """(path, size) of the pieces, in order, of a ZIP of the rows' data (text or bytes; null is empty) under their names.

    Names should be unique; a null name is left out. An empty table gives an empty ZIP.
    """
    scratch, folder = Scratch(rows.sparkSession), folder.rstrip("/")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, at = f"body-{uuid.uuid4().hex}", 0
        own, base = pafs.FileSystem.from_uri(folder)
        out = None
        for batch in batches:
            found = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                out = out or own.open_output_stream(f"{base}/{piece}")
                plain = value.as_py() or b""
                whole, crc, packed = _member(key.as_py().encode(), plain)
                out.write(whole)
                found.append((piece, at, key.as_py(), crc, packed, len(plain)))
                at += len(whole)
            cols = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["piece", "at", "name", "crc", "packed", "plain"])
        if out:
            out.close()

    index = scratch.save(rows.where(F.col(name).isNotNull()).select(F.col(name).cast("string"), F.col(data).cast("binary")).mapInArrow(pack, INDEX), "index")
    size = F.lit(30) + F.octet_length("name") + F.col("packed")
    bodies = index.groupBy("piece").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("piece").collect()
    offsets = list(accumulate((b["bytes"] for b in bodies), initial=0))
    begins = F.broadcast(rows.sparkSession.createDataFrame([(b["piece"], o) for b, o in zip(bodies, offsets, strict=False)], "piece string, begin long"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, n = f"directory-{uuid.uuid4().hex}", 0
        own, base = pafs.FileSystem.from_uri(folder)
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                out = out or own.open_output_stream(f"{base}/{piece}")
                entry = _entry(r["name"].encode(), r["crc"], r["packed"], r["plain"], r["offset"], zip64_from)
                out.write(entry)
                n += len(entry)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([n], pa.int64())], ["piece", "bytes"])

    placed = index.join(begins, "piece").withColumn("offset", F.col("begin") + F.col("at")).select("name", "crc", "packed", "plain", "offset")
    directory = scratch.save(placed.mapInArrow(describe, "piece string, bytes long"), "directory").orderBy("piece").collect()
    pieces = [(b["piece"], b["bytes"]) for b in [*bodies, *directory]]
    tail = _tail(sum(b["n"] for b in bodies), sum(d["bytes"] for d in directory), offsets[-1], zip64_from)
    with store.open_output_stream(f"{root}/end") as out:
        out.write(tail)
    return [(f"{folder}/{p}", n) for p, n in [*pieces, ("end", len(tail))]]


def join_pieces(spark: SparkSession, pieces: list[tuple[str, int]], path: str) -> None:
    """One file of the pieces: tasks copy each to its place where files can be written anywhere; else the store joins them."""
    store, target = pafs.FileSystem.from_uri(path)
    if not isinstance(store, pafs.LocalFileSystem):
        fs, first = _file(spark, pieces[0][0])
        jvm = spark.sparkContext._jvm
        others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(pieces) - 1)
        for i, (piece, _) in enumerate(pieces[1:]):
            others[i] = jvm.org.apache.hadoop.fs.Path(piece)
        if len(others):
            fs.concat(first, others)
        if not fs.rename(first, jvm.org.apache.hadoop.fs.Path(path)):
            raise OSError(f"{path} can't be written")
        return
    begins = accumulate((n for _, n in pieces), initial=0)
    with open(target, "wb") as out:
        out.truncate(sum(n for _, n in pieces))
    places = spark.createDataFrame([(pafs.FileSystem.from_uri(p)[1], b) for (p, _), b in zip(pieces, begins, strict=False)], "piece string, begin long").repartition(min(len(pieces), 200))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(r["piece"], "rb") as read, open(target, "r+b") as out:
                    out.seek(r["begin"])
                    while block := read.read(1 << 20):
                        out.write(block)
            yield batch

    places.mapInArrow(copy, "piece string, begin long").write.format("noop").mode("overwrite").save()


def read_zip(spark: SparkSession, path: str, tasks: int = 8) -> DataFrame:
    """(path, data) of a ZIP's members; each of the tasks unpacks its share of the names."""
    _, local = pafs.FileSystem.from_uri(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with zipfile.ZipFile(local) as archive:
                    for name in archive.namelist():
                        if zlib.crc32(name.encode()) % tasks == k:
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive.read(name)], pa.binary())], ["path", "data"])

    return spark.range(0, tasks, numPartitions=tasks).mapInArrow(unpack, "path string, data binary")
