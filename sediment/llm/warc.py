"""WARC archives as seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames, each holding whole WARC records, then
a skippable frame with the record index and a skippable frame with the seek table of the
public Zstandard seekable format. A record is found by (frame, offset within the frame's
decoded bytes), so that one record costs two range reads: the footer once, then its frame. Readers
take frames and records from the footer of the bundle alone; a record that does not agree with its
header or digest is an error.

Nulls: a null payload is stored as an empty one, a null target URI is left out and a null
page id is written as ``null`` and read back as null. Empty tables give no bundle and no
rows. Repeated rows are separate records with one record identifier, and a look-up gives all of them; rows that
share the largest page id of a group of equal payloads are all responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import make_remote_dir, materialize, open_remote, partitions_for, scratch_path, sliced, small_batches, utf8

#: Fixed values of the Zstandard seekable format and of WARC 1.1.
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "page_id long, record_id string, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD_SCHEMA = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Decoded bytes that one task reads back, about.
READ_BYTES = 32 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(text: str) -> int | None:
    number = text[len("<urn:page:") : -1]
    return None if number == "null" else int(number)


def encode_record(page_id, url, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the full length but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int) -> tuple[dict, bytes]:
    """(header fields, block) of the record at a place in a decoded frame."""
    end = data.index(b"\r\n\r\n", at)
    first, *fields = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in fields)
    start, size = end + 4, int(head["Content-Length"])
    return head, data[start : start + size]


class BundleWriter:
    """Streams records into one bundle; memory holds one frame and the index."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard

        store, path = open_remote(uri)
        self.uri, self.out, self.limit = uri, store.open_output_stream(path, compression=None), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.buffer, self.size, self.offset, self.frames, self.open_rows, self.rows = [], 0, 0, [], [], []

    def add(self, page_id, record: bytes) -> None:
        self.open_rows.append((page_id, self.size, len(record)))
        self.buffer.append(record)
        self.size += len(record)
        if self.size >= self.limit:
            self.flush()

    def flush(self) -> None:
        if not self.buffer:
            return
        packed = self.zstd.compress(b"".join(self.buffer))
        self.out.write(packed)
        self.rows += [(p, record_id(p), self.uri, len(self.frames), self.offset, len(packed), at, n) for p, at, n in self.open_rows]
        self.frames.append((len(packed), self.size))
        self.offset += len(packed)
        self.buffer, self.size, self.open_rows = [], 0, []

    def close(self) -> list[tuple]:
        self.flush()
        index = self.zstd.compress(json.dumps([[r[1], r[3], r[6]] for r in self.rows]).encode())  # identifier, frame, offset in the frame
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)
        self.out.close()
        return self.rows


def read_seek_table(handle, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decoded bytes) of each frame, from the footer alone."""
    count, _, magic = struct.unpack("<IBI", handle.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    table = handle.read_at(8 * count, size - 9 - 8 * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def read_index(handle, size: int, frames: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(record identifier, frame, offset in it) of every record, from the footer's index, which follows the last frame."""
    import zstandard

    at = sum(frames[-1][:2]) if frames else 0
    magic, length = struct.unpack("<II", handle.read_at(8, at))
    if magic != SKIPPABLE_INDEX:
        raise ValueError("no record index")
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompressobj().decompress(handle.read_at(length, at + 8)))]


def read_records(bundle: str, identifier: str) -> list[tuple[dict, bytes]]:
    """The records of an identifier: reads the footer and their frames."""
    import zstandard

    store, path = open_remote(bundle)
    with store.open_input_file(path) as handle:
        frames = read_seek_table(handle, handle.size())
        out = []
        for own, frame, offset in read_index(handle, handle.size(), frames):
            if own == identifier:
                at, packed, plain = frames[frame]
                out.append(decode_record(zstandard.ZstdDecompressor().decompress(handle.read_at(packed, at), max_output_size=plain), offset))
    return out


def link_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds ``payload`` (binary), ``rep`` (the group's largest page id) and ``is_revisit``.

    Groups of equal payloads are found on SHA-256 with map-side combining, so a hot
    payload never meets in one task; only digests of groups are joined back.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.length("payload").cast("long"))
    groups = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.filter("n > 1").select("digest", "rep"), "warc-groups")
    return rows.join(groups, "digest", "left").withColumn("is_revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("rep")) & F.col("rep").isNotNull(), F.lit(False)))


def write_bundles(linked: DataFrame, folder: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write rows of :func:`link_revisits` as bundles below ``folder``; returns the record index.

    Each task writes files under names of its own and only files whose rows were committed
    to the index table are ever read, so a task that is lost and run again does no harm.
    """
    small_batches(linked.sparkSession)
    make_remote_dir(folder)

    def write(batches):
        names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
        writer, written = None, 0
        for batch in sliced(batches, "payload"):
            for page_id, url, payload, rep, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "rep", "is_revisit")), strict=True):
                if writer is None:
                    writer, written = BundleWriter(f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst", frame_bytes, level), 0
                record = encode_record(page_id, url, payload, rep, revisit, date)
                writer.add(page_id, record)
                written += len(record)
                if written >= bundle_bytes:
                    yield index_batch(names, writer.close())
                    writer = None
        if writer is not None:
            yield index_batch(names, writer.close())

    return materialize(linked.select("page_id", "url", "payload", "rep", "is_revisit").mapInArrow(write, INDEX_SCHEMA), "warc-index")


def index_batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names: footers give frames and records, frames are dealt to tasks.

    Nothing but the names and the sum of ``record_bytes``, for the number of tasks, is taken from ``index``.
    """
    frame_schema = "bundle string, at long, packed long, plain long, places array<long>"

    def frames(batches):
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                store, path = open_remote(uri)
                with store.open_input_file(path) as handle:
                    table = read_seek_table(handle, handle.size())
                    places: list[list[int]] = [[] for _ in table]
                    for _, frame, offset in read_index(handle, handle.size(), table):
                        places[frame].append(offset)
                cols = list(zip(*table, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(table), pa.string()), *(pa.array(c, pa.int64()) for c in cols), pa.array(places, pa.list_(pa.int64()))], names=[f.split()[0] for f in frame_schema.split(", ")])

    def records(batches):
        import zstandard

        zstd = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        uri, handle = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != uri:
                    store, path = open_remote(row["bundle"])
                    uri, handle = row["bundle"], store.open_input_file(path)
                data = zstd.decompress(handle.read_at(row["packed"], row["at"]), max_output_size=row["plain"])
                rows = [parsed(*decode_record(data, at)) for at in row["places"]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RECORD_SCHEMA.split(", ")])

    plain = index.agg(F.coalesce(F.sum("record_bytes"), F.lit(0))).first()[0]
    tasks = max(partitions_for(index), -(-plain // READ_BYTES))  # descriptors are small, what they stand for isn't: a number is given
    found = index.select("bundle").distinct().mapInArrow(frames, frame_schema)
    return found.repartition(tasks, "bundle", "at").sortWithinPartitions("bundle", "at").mapInArrow(records, RECORD_SCHEMA)


def parsed(head: dict, block: bytes) -> tuple:
    """Row of RECORD_SCHEMA; a response's length and digest are taken from the stored payload and checked."""
    http, payload = block.split(b"\r\n\r\n", 1)
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if (base32_sha1(payload), len(payload)) != (digest, size) if kind == "response" else payload:
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(head["WARC-Record-ID"]), head["WARC-Record-ID"], head.get("WARC-Target-URI"), size, digest, kind, refers


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as bundles and read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_bundles(link_revisits(pages), scratch_path(spark, "warc"))
    return read_bundles(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex, strlen(html)) AS rep
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = rep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = rep THEN NULL ELSE rep END AS refers_to
FROM d
"""
