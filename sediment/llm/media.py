"""Media columns: content-addressed payloads in tar shards.

A payload is the text's UTF-8 bytes, padded with zeros to a positive multiple of 64, stored
as the samples of an 8-bit greyscale PNG of width 64 (lossless). A writing task appends each
distinct payload once to its tar shard under its SHA-256; rows carry digest, shard, offset
and length. A digest that several shards hold is addressed by the first of them, so equal
texts share one address. Metadata columns come from range reads of the 33 header bytes alone (:func:`read_headers`);
whole payloads are range-read only for features.

Nulls and empty texts give 64 zero bytes. Null ids are kept. Repeated rows share an address
and give one row each. Empty tables give no shard and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import make_remote_dir, materialize, open_remote, partitions_for, scratch_path, sliced, small_batches, utf8

UNIT = 64
#: Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33

REF_SCHEMA = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
ADDRESS_SCHEMA = "digest binary, shard string, offset long, length long"
HEADER_SCHEMA = ADDRESS_SCHEMA + ", width int, height int, bit_depth int"
#: Stored bytes that one task reads, about.
READ_BYTES = 32 << 20
FEATURE_SCHEMA = HEADER_SCHEMA + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, level: int = 1) -> bytes:
    rows = np.zeros((len(samples) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first 33 bytes."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG as :func:`encode_png` writes it (filter 0 in every row)."""
    width, height, _ = read_header(media[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while media[at + 4 : at + 8] != b"IEND":
        size = int.from_bytes(media[at : at + 4], "big")
        if media[at + 4 : at + 8] == b"IDAT":
            packed.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filter other than 0")
    return np.ascontiguousarray(rows[:, 1:]).tobytes()


def feature_of(samples: bytes, width: int, height: int) -> str:
    """Size, mean sample and an average hash over the columns."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    sums = grid.sum(axis=0, dtype=np.int64)
    total = int(sums.sum())
    bits = np.packbits(sums * UNIT > total).tobytes().hex()
    return f"{width}x{height};mean={total / len(samples):.4f};ahash={bits}"


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 28, level: int = 1) -> DataFrame:
    """Write tar shards below ``folder``; returns (doc_id, n_bytes, digest, shard, offset, length).

    A task holds one payload and the digests of its open shard. Shards have names of their
    own and are read only by committed rows, so lost tasks can run again.
    """
    make_remote_dir(folder)

    def write(batches):
        out, path, at, seen = None, None, 0, {}
        files, _ = open_remote(folder)
        names = [f.split()[0] for f in REF_SCHEMA.split(", ")]
        for batch in sliced(batches, "data"):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                samples = pad(data)
                digest = hashlib.sha256(samples).digest()
                if digest not in seen:
                    if out is not None and at >= shard_bytes:
                        out.write(bytes(1024))
                        out.close()
                        out = None
                    if out is None:
                        path, at, seen = f"{folder}/shard-{uuid.uuid4().hex}.tar", 0, {}
                        out = files.open_output_stream(open_remote(path)[1], compression=None)
                    media = encode_png(samples, level)
                    info = tarfile.TarInfo(digest.hex() + ".png")
                    info.size = len(media)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512))
                    seen[digest] = (at + 512, len(media))
                    at += 512 + len(media) + -len(media) % 512
                rows.append((doc_id, len(data), digest, path, *seen[digest]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data")).mapInArrow(write, REF_SCHEMA), "media-refs")


def canonical(refs: DataFrame) -> DataFrame:
    """One address for each digest: the least (shard, offset)."""
    return refs.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def read_ranges(addresses: DataFrame, row, schema: str, kinds: list) -> DataFrame:
    """Addresses with ``row(read, length)`` of each stored payload, in order of their place; ``read(at, n)`` is a range read within the payload."""
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches):
        uri, handle = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != uri:
                    files, path = open_remote(shard)
                    uri, handle = shard, files.open_input_file(path)
                rows.append((digest, shard, offset, length, *row(lambda at, n, offset=offset: handle.read_at(n, offset + at), length)))  # noqa: B023
            if rows:
                both = [pa.binary(), pa.string(), pa.int64(), pa.int64(), *kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), both, strict=True)], names=names)

    # runs of 8 MB of a shard are a task's unit, so that a large shard is read by many tasks;
    # addresses are small, what they stand for isn't: a number of tasks is given
    stored = addresses.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(partitions_for(addresses), -(-stored // READ_BYTES))
    dealt = addresses.repartition(tasks, F.col("shard"), F.expr("offset div 8388608")).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(read, schema)


HEADER_KINDS = [pa.int32()] * 3


def header_of(read, length: int) -> tuple:
    return read_header(read(0, HEADER_BYTES))


def read_headers(addresses: DataFrame) -> DataFrame:
    """Metadata of each stored payload from its header bytes, whatever its size."""
    return read_ranges(addresses, header_of, HEADER_SCHEMA, HEADER_KINDS)


def read_features(addresses: DataFrame) -> DataFrame:
    """Metadata by a range read of the header, and what needs the whole of each stored payload by one of the rest."""

    def row(read, length: int) -> tuple:
        head = read(0, HEADER_BYTES)
        width, height, depth = read_header(head)
        media = head + read(HEADER_BYTES, length - HEADER_BYTES)
        samples = decode_png(media)
        return width, height, depth, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples, width, height)

    return read_ranges(addresses, row, FEATURE_SCHEMA, [*HEADER_KINDS, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its payload's address, metadata and features."""
    small_batches(docs.sparkSession)
    refs = store(docs, folder, id_col, text_col)
    addresses = materialize(canonical(refs), "media-addresses")
    return refs.select("doc_id", "n_bytes", "digest").join(materialize(read_features(addresses), "media-features"), "digest")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = media_columns(docs, scratch_path(spark, "media"))
    contract = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return out.select(*contract, F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length", "width", "height", "bit_depth")
