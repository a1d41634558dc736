"""Questions that chunks of rows ask about keys of the whole input, and their answers.

A chunk sends its distinct 64-bit keys once to the parts that own them, packed into one blob
a part; a part sums what it is sent and answers each chunk in the order of its question. A key
therefore meets in its part once for each chunk however many rows have it, and no row exists
for a single key.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOB_SCHEMA = "chunk string, kind int, part int, blob binary, words binary"


def pack(*parts: np.ndarray | bytes, level: int = 1) -> bytes:
    """Byte strings and arrays as one Zstandard frame."""
    import zstandard

    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=level).compress(struct.pack(f"<I{len(raw)}Q", len(raw), *map(len, raw)) + b"".join(raw))


def unpack(blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", data)
    out, at = [], 4 + 8 * n
    for size in struct.unpack_from(f"<{n}Q", data, 4):
        out.append(data[at : at + size])
        at += size
    return out


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array by significance, which packs better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["chunk", "kind", "part", "blob", "words"])


def key_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; rises with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def distinct_pairs(keys: np.ndarray, more: np.ndarray):
    """Distinct (key, more) sorted by key, the place of each row among them, and their counts."""
    order = np.lexsort((more, keys))
    a, b = keys[order], more[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    index = np.empty(len(a), np.int64)
    index[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return (a[at], b[at]), index, np.diff(np.append(at, len(a)))


def distinct(keys: np.ndarray, more: np.ndarray | None):
    if more is not None:
        return distinct_pairs(keys, more)
    own, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return (own, None), index, counts


def ask_repeats(chunk: str, kind: int, keys: np.ndarray, parts: int, more: np.ndarray | None = None) -> pa.RecordBatch:
    """The question which of ``keys`` occur twice or more, over all chunks and within this one; with ``more``, which pairs of both."""
    own, _, counts = distinct(keys, more)
    bounds = np.searchsorted(key_parts(own[0], parts), np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(bounds)):
        at = slice(bounds[p], bounds[p + 1])
        rows.append((chunk, kind, int(p), pack(planes(np.diff(own[0][at], prepend=np.uint64(0))), np.packbits(counts[at] > 1), b"" if more is None else own[1][at]), None))
    return rows_batch(rows)


def answer_repeats(key, table):
    """For one part: a bit for each key asked about."""
    asked = [unpack(b) for b in table["blob"].to_pylist()]
    keys = [np.cumsum(from_planes(a[0], np.uint64), dtype=np.uint64) for a in asked]
    many = np.concatenate([np.unpackbits(np.frombuffer(a[1], np.uint8))[: len(k)] for a, k in zip(asked, keys, strict=True)])
    more = np.concatenate([np.frombuffer(a[2], np.uint64) for a in asked])
    _, index, _ = distinct(np.concatenate(keys), more if len(more) else None)
    repeated = np.bincount(index, weights=1 + many) > 1
    out, at = [], 0
    for chunk, own in zip(table["chunk"].to_pylist(), keys, strict=True):
        out.append((chunk, key[0].as_py(), key[1].as_py(), np.packbits(repeated[index[at : at + len(own)]]).tobytes(), None))
        at += len(own)
    return pa.Table.from_batches([rows_batch(out)])


def repeats(asked: DataFrame) -> DataFrame:
    """The answers to rows of :func:`ask_repeats`."""
    return asked.groupBy("kind", "part").applyInArrow(answer_repeats, BLOB_SCHEMA)


def told(keys: np.ndarray, answers: dict[int, bytes], parts: int, more: np.ndarray | None = None) -> np.ndarray:
    """Whether each of ``keys`` (and ``more``) is repeated, by the blobs of :func:`answer_repeats` of one kind."""
    (own, _), index, _ = distinct(keys, more)
    bounds = np.searchsorted(key_parts(own, parts), np.arange(parts + 1))
    flags = np.zeros(len(own), bool)
    for p in np.flatnonzero(np.diff(bounds)):
        n = bounds[p + 1] - bounds[p]
        flags[bounds[p] : bounds[p + 1]] = np.unpackbits(np.frombuffer(answers[int(p)], np.uint8))[:n]
    return flags[index]


def ask_splits(chunk: str, kind: int, keys: np.ndarray, finer: np.ndarray, parts: int) -> pa.RecordBatch:
    """The question how buckets ``keys`` split into buckets ``finer``.

    Rows with finer identifier 0 are never equal to others.
    """
    own, _, counts = distinct_pairs(keys, finer)
    bounds = np.searchsorted(key_parts(own[0], parts), np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(bounds)):
        at = slice(bounds[p], bounds[p + 1])
        rows.append((chunk, kind, int(p), pack(planes(np.diff(own[0][at], prepend=np.uint64(0))), own[1][at], np.minimum(counts[at], 2).astype(np.uint8)), None))
    return rows_batch(rows)


ALONE, SETTLED, OPEN, SETTLED_AMONG_OPEN = 0, 1, 2, 3


def answer_splits(key, table):
    """For one part: a code for each pair asked about.

    ALONE: nothing else has the key. SETTLED: another row has both, and so have all rows of the key.
    OPEN: others have the key, none has both. SETTLED_AMONG_OPEN: another row has both; some row of the key is open.
    """
    asked = [unpack(b) for b in table["blob"].to_pylist()]
    keys = [np.cumsum(from_planes(a[0], np.uint64), dtype=np.uint64) for a in asked]
    finer = [np.frombuffer(a[1], np.uint64) for a in asked]
    times = np.concatenate([np.frombuffer(a[2], np.uint8) for a in asked]).astype(np.float64)
    all_keys, all_finer = np.concatenate(keys), np.concatenate(finer)
    pairs, of_pair, _ = distinct_pairs(all_keys, all_finer)
    new_key = np.cumsum(np.append(False, pairs[0][1:] != pairs[0][:-1]))
    pair_count = np.bincount(of_pair, weights=times)
    key_count = np.bincount(new_key, weights=pair_count)[new_key]
    settled = (pair_count > 1) & (pairs[1] != 0)
    any_open = np.bincount(new_key, weights=~settled)[new_key] > 0
    code = np.where(key_count < 2, ALONE, np.where(settled, np.where(any_open, SETTLED_AMONG_OPEN, SETTLED), OPEN)).astype(np.uint8)[of_pair]
    out, at = [], 0
    for chunk, own in zip(table["chunk"].to_pylist(), keys, strict=True):
        out.append((chunk, key[0].as_py(), key[1].as_py(), pack(code[at : at + len(own)]), None))
        at += len(own)
    return pa.Table.from_batches([rows_batch(out)])


def splits(asked: DataFrame) -> DataFrame:
    """The answers to rows of :func:`ask_splits`."""
    return asked.groupBy("kind", "part").applyInArrow(answer_splits, BLOB_SCHEMA)


def told_splits(keys: np.ndarray, finer: np.ndarray, answers: dict[int, bytes], parts: int) -> np.ndarray:
    """The code of each row, by the blobs of :func:`answer_splits`."""
    own, index, _ = distinct_pairs(keys, finer)
    bounds = np.searchsorted(key_parts(own[0], parts), np.arange(parts + 1))
    codes = np.zeros(len(own[0]), np.uint8)
    for p in np.flatnonzero(np.diff(bounds)):
        codes[bounds[p] : bounds[p + 1]] = np.frombuffer(unpack(answers[int(p)])[0], np.uint8)
    return codes[index]
