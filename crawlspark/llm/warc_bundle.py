"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a group of whole records, with a seek table in a
skippable frame at its end (the layout of the Zstandard seekable format: frame sizes, number of frames, magic number).
The index maps a record's identifier to (bundle, frame, offset in the frame, length), so that one record is read by
decompressing one frame. Tasks write and read bundles; each file gets its name by a rename when it is whole, so a task
that runs again puts the same file in the same place.

Duplicates: of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response
and the others are revisits, which have no payload of their own. Equality goes by SHA-1, WARC's payload digest, and the
length; groups are counted with partial sums, and only groups of two or more are joined back.

Defined results: a null payload is empty; a null URL leaves out WARC-Target-URI; rows without an id are
responses that only their place in the index tells apart; repeated rows with the largest id are all responses; an empty table gives no bundle.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .scratch import Scratch

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20


def record_id(id_: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{id_}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        headers.append(f"X-Page-Id: {page_id}")
    if url is not None:
        headers.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    headers.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        headers += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    headers += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, where the next record begins)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at offset {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    begin = end + 4
    n = int(headers["Content-Length"])
    if data[begin + n : begin + n + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {at} does not end where its length says")
    return headers, data[begin : begin + n], begin + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: (compressed size, decompressed size) of each."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, path: str):
        fs, name = pa.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{path} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.unpack.decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)[:2]

    def close(self) -> None:
        self.file.close()


class BundleWriter:
    """One task's bundles; gives index rows (id, bundle, frame, offset, length) as bundles are finished."""

    def __init__(self, folder: str, task: int, frame_bytes: int, bundle_bytes: int):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.uri, self.task, self.frame_bytes, self.bundle_bytes = folder, task, frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=3)
        self.n, self.out, self.attempt = 0, None, uuid.uuid4().hex
        self.frame, self.frames, self.rows = bytearray(), [], []

    def add(self, id_: int, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            # Named by the attempt: one that runs later, with rows in another order, leaves the index's bundles alone.
            self.name = f"bundle-{self.task:06d}-{self.n:04d}-{self.attempt}.warc.zst"
            self.temporary = f"{self.folder}/.{self.name}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.rows.append((id_, f"{self.uri}/{self.name}", len(self.frames), len(self.frame), len(record)))
        self.frame += record
        if len(self.frame) >= self.frame_bytes:
            self._end_frame()
            if sum(x for x, _ in self.frames) >= self.bundle_bytes:
                yield from self.end()

    def _end_frame(self) -> None:
        packed = self.pack.compress(bytes(self.frame))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    def end(self) -> Iterator[tuple]:
        if self.out is None:
            return
        if self.frame:
            self._end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        yield from self.rows
        self.n, self.out, self.frames, self.rows = self.n + 1, None, [], []


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def plan_revisits(pages: DataFrame, scratch: Scratch, id_col: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    groups = (
        rows.select("id", F.col("digest").alias("same"), F.octet_length("payload").alias("n"))
        .where(F.col("n") >= min_bytes)
        .groupBy("same", "n")
        .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    groups = scratch.save(groups, "groups")
    joined = rows.join(groups, (F.col("digest") == F.col("same")) & (F.octet_length("payload") == F.col("n")), "left")
    return joined.select("id", "url", "payload", "digest", F.when(F.col("last") != F.col("id"), F.col("last")).alias("refers_to"))


def write_bundles(
    pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 1000, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Writes one record per row into bundles below ``folder`` (a URI that all executors share) and returns the index."""
    small_batches(pages.sparkSession)
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    schema = pa.schema([("id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, TaskContext.get().partitionId(), frame_bytes, bundle_bytes)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for id_, at, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    yield from writer.add(id_, make_record(id_, at, payload, digest, refers))
            yield from writer.end()

        yield from _batches(rows(), schema)

    index = plan_revisits(pages, scratch, id_col, url, html, min_bytes).mapInArrow(write, "id long, bundle string, frame long, offset long, length long")
    return scratch.save(index, "index")


def read_records(index: DataFrame) -> DataFrame:
    """Every record that the index names: id, type, url, digest (as the record says), refers_to and payload.

    The records of a frame are read by one task, which decompresses the frame once.
    """
    schema = pa.schema([("id", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            reader, at, data = None, None, b""
            for batch in batches:
                for id_, bundle, frame, offset in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (bundle, frame) != at:
                        if at is None or bundle != at[0]:
                            if reader:
                                reader.close()
                            reader = BundleReader(bundle)
                        data, at = reader.frame(frame), (bundle, frame)
                    headers, payload, _ = parse_record(data, offset)
                    if headers["WARC-Record-ID"] != record_id(id_):
                        raise ValueError(f"{bundle}, frame {frame}, offset {offset} holds another record than {id_}")
                    refers = headers.get("X-Refers-To-Page-Id")
                    yield id_, headers["WARC-Type"], headers.get("WARC-Target-URI"), headers["WARC-Payload-Digest"].removeprefix("sha1:"), refers and int(refers), payload
            if reader:
                reader.close()

        yield from _batches(rows(), schema, 64)

    ordered = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.select("id", "bundle", "frame", "offset").mapInArrow(read, "id long, type string, url string, digest string, refers_to long, payload binary")



def resolve_revisits(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, type, refers_to, digest, n_bytes) with revisits resolved through the responses that they refer to."""
    facts = records.select("id", "type", "refers_to", F.when(F.col("type") == "response", F.sha1("payload")).otherwise(F.col("digest")).alias("digest"), F.octet_length("payload").cast("long").alias("own"))
    facts = scratch.save(facts, "facts")
    wanted = facts.where("refers_to is not null").select(F.col("refers_to").alias("to")).distinct()
    responses = facts.where("type = 'response'").join(wanted, F.col("id") == F.col("to"), "left_semi").groupBy(F.col("id").alias("to")).agg(F.max("own").alias("whole"), F.max("digest").alias("whole_digest"))
    responses = scratch.save(responses, "responses")
    joined = facts.join(responses, F.col("refers_to") == F.col("to"), "left")
    return joined.select("id", "type", "refers_to", F.coalesce("whole_digest", "digest").alias("digest"), F.coalesce("whole", "own").alias("n_bytes"))
