"""Removal of repeated substrings by refinement of suffix buckets.

A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else in
the input. Full suffix arrays are not built; the order of suffixes is only needed as far as the
question "do two suffixes share ``length`` bytes", so buckets of equal identifiers stand for it:

* the identifier of a 2q-gram at i is made from the identifiers of the q-grams at i and at the
  later offset i + q, from single bytes up to the largest power of two needed, and these are reused for every length;
* round 0 keeps, of the q-grams within each string of ``length`` bytes, the least one (its
  anchor), and drops anchors alone in their bucket;
* round 1 refines the buckets of the anchors that are left: the strings around an anchor fall
  into blocks of 16 start offsets. A block whose common bytes are alone in their bucket has no
  repeats; a block whose whole bytes share a bucket has only repeats;
* round 2 refines the buckets with members still open down to single strings of ``length``
  bytes; settled members of those buckets are asked too, as partners of the open ones.

Every round asks which bucket identifiers (64-bit hashes) occur twice; see ``exchange``.
Equal strings have equal anchors and blocks, so no repeat is missed. Identifiers alone only make
candidates: blocks and single strings count as repeated when a second 64-bit hash, made from their bytes and from
nothing else, agrees as well, 128 bits in all (64 for blocks that share all but the outer 15 bytes at either side).

Nulls are empty texts. Repeated rows repeat each other's bytes. Texts shorter than
``length`` lose nothing. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import materialize, partitions_for, row_key, sliced, small_batches, utf8
from sediment.llm.exchange import ALONE, BLOB_SCHEMA, OPEN, SETTLED, SETTLED_AMONG_OPEN, ask_repeats, ask_splits, pack, repeats, rows_batch, splits, told, told_splits, unpack

LENGTH = 200
GRAM = 40
BLOCK = 16
CHUNK_BYTES = 4 << 20
#: Bytes whose identifiers are made at once; they should fit a core's cache.
STRETCH = 1 << 16
#: Bytes of text whose keys one part answers for, about.
PART_BYTES = 32 << 20

_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def joined(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bucket identifiers of longer strings from those at an offset and at a later one."""
    with np.errstate(over="ignore"):
        out = left + np.uint64(salt)
        out *= _A
        out ^= right * _B
        out ^= out >> np.uint64(32)
        out *= _C
        out ^= out >> np.uint64(29)
        return out


class Text:
    """Identifiers of all grams of a stretch of bytes, by doubling up to ``top`` bytes."""

    def __init__(self, data: np.ndarray, top: int = 128):
        self.top = top
        self.of = {1: joined(np.arange(256, dtype=np.uint64), np.zeros(1, np.uint64), 1).take(data)}
        size = 1
        while size < top:
            wide = self.of[size]
            n = max(0, len(wide) - size)
            self.of[2 * size] = joined(wide[:n], wide[size : size + n], 2 * size)
            if size not in (8, 32):
                del self.of[size]
            size *= 2

    def grams(self) -> np.ndarray:
        """Identifiers of GRAM (32 + 8) bytes at each position; of the others only those of ``top`` bytes stay."""
        n = max(0, len(self.of[8]) - 32)
        out = joined(self.of[32][:n], self.of[8][32 : 32 + n], 40)
        self.of = {self.top: self.of[self.top]}
        return out

    def at(self, where: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
        """Identifiers of ``size`` bytes (``top`` or more) at some positions."""
        out = self.of[self.top][where]
        for at in [*range(self.top, size - self.top, self.top), size - self.top]:
            out = joined(out, self.of[self.top][where + at], size + (salt << 16))
        return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


class Chunk:
    """Documents of a chunk, one zero byte between them, and the strings that start in them."""

    def __init__(self, blob: bytes, length: int):
        data, sizes = unpack(blob)[:2]
        self.data, self.sizes, self.length = np.frombuffer(data, np.uint8), np.frombuffer(sizes, np.int64), length
        self.top = 1 << (length - BLOCK + 1).bit_length() - 1
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.ends = self.starts + self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes + 1)

    def bytes_at(self, where: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` bytes at some positions that owes nothing to the identifiers."""
        out = np.full(len(where), size, np.uint64)
        if not len(where):
            return out
        words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        with np.errstate(over="ignore"):
            for low in range(0, len(where), STRETCH):
                part, mixed = where[low : low + STRETCH], out[low : low + STRETCH]
                for at in [*range(0, size - 8, 8), size - 8]:
                    mixed ^= words[part + at]
                    mixed *= _D
                    mixed ^= mixed >> np.uint64(31)
        return out

    def stretches(self, size: int = STRETCH):
        """(Text, base, low, high, p, first, last, doc, key) of each stretch of starts: its anchors and the starts they stand for."""
        length, width = self.length, self.length - GRAM + 1
        for low in range(0, len(self.data), size):
            high = min(len(self.data), low + size)  # starts in [low, high)
            base, end = max(0, low - BLOCK), min(len(self.data), high + 2 * length + BLOCK)
            text = Text(self.data[base:end], self.top)
            grams = text.grams()
            start = np.arange(low, high)
            doc = self.doc[low:high]
            ok = start + length <= self.ends[doc]
            start, doc = start[ok], doc[ok]
            if not len(start):
                continue
            with np.errstate(over="ignore"):
                bits = max(1, int(len(grams)).bit_length())
                packed = (grams & ~np.uint64((1 << bits) - 1)) | np.arange(len(grams), dtype=np.uint64)
            p = (least(packed, width)[start - base] & np.uint64((1 << bits) - 1)).astype(np.int64) + base
            new = np.flatnonzero(np.diff(p, prepend=-1))
            yield text, base, low, high, p[new], start[new], start[np.append(new[1:], len(p)) - 1], doc[new], grams[p[new] - base]

    @cached_property
    def all_stretches(self) -> list[tuple]:
        """The stretches, made once for the anchors' keys and for their blocks."""
        return list(self.stretches())

    def anchor_keys(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(keys for *_, keys in self.all_stretches)])

    def blocks(self, anchored: np.ndarray):
        """Blocks of the anchors that are left, stretch by stretch: (text, base, low, high, core, full).

        low, high: first and last start; core: identifier of the bytes common to all strings of
        the block; full: a hash of all their bytes, 0 where the document ends before them.
        """
        at = 0
        for text, base, least_start, end_start, p, first, last, doc, _ in self.all_stretches:
            left = anchored[at : at + len(p)]
            at += len(p)
            p, first, last, doc = p[left], first[left], last[left], doc[left]
            lowest = (p - last) // BLOCK
            times = (p - first) // BLOCK - lowest + 1
            of = np.repeat(np.arange(len(p)), times)
            block = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + lowest[of]
            q = p[of] - block * BLOCK
            low, high = np.maximum(q - BLOCK + 1, first[of]), np.minimum(q, last[of])
            salt = block.astype(np.uint64)
            core = joined(text.at(q - base, self.length - BLOCK + 1), salt, 3)
            full = np.zeros(len(q), np.uint64)
            # a block cut by the stretch's ends is told by its strings, so that it isn't counted twice
            whole = (q - BLOCK + 1 >= np.maximum(self.starts[doc[of]], least_start)) & (q < end_start) & (q + self.length <= self.ends[doc[of]])
            full[whole] = self.bytes_at(q[whole] - BLOCK + 1, self.length + BLOCK - 1) | np.uint64(1)
            yield text, base, low, high, core, full


def gather(batches):
    """Chunks of whole documents (kind 0)."""
    held, size = [], 0

    def made():
        table = pa.Table.from_batches(held)
        data = table["data"].to_pylist()
        ids = table["doc_id"].combine_chunks()
        return rows_batch([(uuid.uuid4().hex, 0, size, pack(b"\0".join(data) + b"\0", np.array([len(x) for x in data], np.int64), pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), *(table[k].to_numpy() for k in ("_k1", "_k2")), level=3), None)])

    for batch in sliced(batches, "data", CHUNK_BYTES // 4):
        held.append(batch)
        size += (pc.sum(pc.binary_length(batch.column("data"))).as_py() or 0) + batch.num_rows
        if size >= CHUNK_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def answers_of(rows: list[dict], kind: int) -> dict[int, bytes]:
    return {r["part"]: r["blob"] for r in rows if r["kind"] == kind}


def round_0(length: int, parts: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = [found[-1] for found in Chunk(row["blob"], length).stretches()]
                yield ask_repeats(row["chunk"], 1, np.concatenate([np.empty(0, np.uint64), *keys]), parts)

    return ask


def split_keys(found: list) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *(f[4] for f in found)]), np.concatenate([none, *(f[5] for f in found)])


def opened(chunk: Chunk, rows: list[dict], parts: int):
    """Blocks after the answers of rounds 0 and 1: (text, base, low, high, code)."""
    anchored = told(chunk.anchor_keys(), answers_of(rows, 1), parts)
    found = list(chunk.blocks(anchored))
    codes, at = told_splits(*split_keys(found), answers_of(rows, 2), parts), 0
    for text, base, low, high, core, _ in found:
        code = codes[at : at + len(core)]
        at += len(core)
        keep = code != ALONE
        yield text, base, low[keep], high[keep], code[keep]


def starts_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    times = high - low + 1
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)


def round_1(length: int, parts: int):
    def ask(_, table):
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        chunk = Chunk(own["blob"], length)
        anchored = told(chunk.anchor_keys(), answers_of(rows, 1), parts)
        return pa.Table.from_batches([ask_splits(own["chunk"], 2, *split_keys(list(chunk.blocks(anchored))), parts)])

    return ask


def round_2(length: int, parts: int):
    def ask(_, table):
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        chunk = Chunk(own["blob"], length)
        keys, checks = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for text, base, low, high, c in opened(chunk, rows, parts):
            starts = starts_of(low[c != SETTLED], high[c != SETTLED])
            keys.append(text.at(starts - base, length))
            checks.append(chunk.bytes_at(starts, length))
        return pa.Table.from_batches([ask_repeats(own["chunk"], 3, np.concatenate(keys), parts, np.concatenate(checks))])

    return ask


def spans_of(chunk: Chunk, rows: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed ranges of a chunk's bytes."""
    lows, highs, single, keys, own = [], [], [], [], []
    for text, base, low, high, code in opened(chunk, rows, parts):
        settled, asked = (code == SETTLED) | (code == SETTLED_AMONG_OPEN), code != SETTLED
        lows.append(low[settled])
        highs.append(high[settled])
        starts = starts_of(low[asked], high[asked])
        single.append(starts)
        keys.append(text.at(starts - base, chunk.length))
        own.append(np.repeat(code[asked] == OPEN, (high - low + 1)[asked]))
    if not lows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    single, keys = np.concatenate(single), np.concatenate(keys)
    repeated = single[told(keys, answers_of(rows, 3), parts, chunk.bytes_at(single, chunk.length)) & np.concatenate(own)]
    low, high = np.concatenate([*lows, repeated]), np.concatenate([*highs, repeated]) + chunk.length
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    if not len(low):
        return low, high
    new = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return low[new], high[np.append(new[1:], len(low)) - 1]


RESULT_SCHEMA = "_k1 long, _k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def cut_out(length: int, parts: int, with_kept: bool):
    def finish(_, table):
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        chunk = Chunk(own["blob"], length)
        _, _, ids, null, k1, k2 = unpack(own["blob"])
        low, high = spans_of(chunk, rows, parts)
        data = chunk.data.tobytes()
        of = np.searchsorted(chunk.starts, low, side="right") - 1
        bounds = np.searchsorted(of, np.arange(len(chunk.sizes) + 1))
        removed, spans, digests, kept_texts = [], [], [], []
        for d, (start, end) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
            kept, at = [], start
            for i in range(bounds[d], bounds[d + 1]):
                kept.append(data[at : low[i]])
                at = int(high[i])
            kept.append(data[at:end])
            kept = b"".join(kept)
            removed.append(end - start - len(kept))
            spans.append(int(bounds[d + 1] - bounds[d]))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode(errors="ignore") if with_kept else None)
        cols = [pa.array(np.frombuffer(k1, np.int64)), pa.array(np.frombuffer(k2, np.int64)), pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(null, bool)), pa.array(chunk.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
        return pa.Table.from_arrays(cols, names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    return finish


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """Per row: _k1, _k2, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    kept is the remaining text, null unless asked for; bytes of a character that was cut are left out of it.
    """
    if length < 64:
        raise ValueError("length must be 64 bytes at least")
    small_batches(docs.sparkSession)
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))
    chunks = materialize(rows.mapInArrow(gather, BLOB_SCHEMA), "substring-chunks")
    total = chunks.agg(F.coalesce(F.sum("part"), F.lit(0))).first()[0]
    parts = max(partitions_for(docs), math.ceil(total / PART_BYTES))
    # big chunks by few rows: AQE would put many into one task by their packed size
    groups = max(partitions_for(docs), math.ceil(total / (4 * CHUNK_BYTES)))
    known = [materialize(repeats(chunks.mapInArrow(round_0(length, parts), BLOB_SCHEMA)), "substring-anchors")]

    def met() -> DataFrame:
        rows = chunks
        for answers in known:
            rows = rows.unionByName(answers)
        return rows.repartition(groups, "chunk").groupBy("chunk")

    known.append(materialize(splits(met().applyInArrow(round_1(length, parts), BLOB_SCHEMA)), "substring-blocks"))
    known.append(materialize(repeats(met().applyInArrow(round_2(length, parts), BLOB_SCHEMA)), "substring-strings"))
    return met().applyInArrow(cut_out(length, parts, with_kept), RESULT_SCHEMA)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated 200-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
