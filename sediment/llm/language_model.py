"""LM scoring with a bigram model smoothed by deleted interpolation.

``P(w | h) = (1 - l) * P1(w) + l * c(h, w) / c(h)`` where P1 is the add-half unigram estimate
and the weight ``l`` depends on the bucket of the context's frequency c(h) (powers of two).
The weights are learned by expectation maximisation on counts held out from the training
documents: every eighth of those (by a hash of the id) is left out of the counts while the
weights are learned and put back for scoring.

Documents are gathered into chunks of some MB and encoded as numbers once. A chunk sends
each of its distinct words and bigrams, with its counts, to the part that owns the key; a part
adds up what it is sent and answers each chunk in the order of its question. So no row exists
for single tokens, a frequent key meets in its part only once for each chunk, and nothing that
grows with the input goes to the driver. Bigrams are identified by 64-bit hashes.

Nulls are empty texts: one end token. Null ids count as training rows. Repeated rows are
counted and scored each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import drop_scratch, materialize, partitions_for, sliced, small_batches
from sediment.llm.exchange import BLOB_SCHEMA, from_planes, key_parts, pack, planes, rows_batch, unpack

CHUNK_BYTES = 4 << 20
#: Tokens that the keys of one part come from, about.
PART_TOKENS = 1_500_000
BUCKETS = 24
TRAIN, HELD_OUT, DEV = 0, 1, 2
END = ""  # no token is empty

SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of all texts, without ends, and the number of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    flat, parents = flat.filter(full), parents.filter(full)
    return flat, np.bincount(parents.to_numpy(), minlength=len(texts)).astype(np.int64)


def encode(batches):
    """Chunks of whole documents: ids, folds, lengths and word numbers; the words beside."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in sliced(batches, "text"):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= CHUNK_BYTES:
            yield rows_batch([encode_chunk(pa.Table.from_batches(held))])
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield rows_batch([encode_chunk(pa.Table.from_batches(held))])


def encode_chunk(table: pa.Table) -> tuple:
    flat, sizes = tokens_of(table["text"].combine_chunks())
    ids, fold = table["doc_id"].combine_chunks(), table["fold"].to_numpy().astype(np.uint8)
    enc = flat.dictionary_encode()
    words = [END, *enc.dictionary.to_pylist()]
    ends = np.cumsum(sizes + 1) - 1
    stream = np.zeros(len(flat) + len(sizes), np.uint32)
    body = np.ones(len(stream), bool)
    body[ends] = False
    stream[body] = enc.indices.to_numpy().astype(np.uint32) + 1
    blob = pack(pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), fold, (sizes + 1).astype(np.int64), planes(stream))
    return (uuid.uuid4().hex, 0, len(stream), blob, pack(" ".join(words).encode()))


class Chunk:
    """A decoded chunk with its distinct bigrams; word numbers are shifted by one, 0 is the start."""

    def __init__(self, blob: bytes):
        ids, null, fold, sizes, stream = unpack(blob)[:5]
        self.ids, self.null = np.frombuffer(ids, np.int64), np.frombuffer(null, bool)
        self.fold, self.sizes = np.frombuffer(fold, np.uint8), np.frombuffer(sizes, np.int64)
        self.stream = from_planes(stream, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1] + 1
        before[np.cumsum(self.sizes) - self.sizes] = 0
        self.width = int(self.stream.max()) + 2
        self.pairs, self.pair_of = np.unique(before * self.width + self.stream, return_inverse=True)
        self.context, self.word = self.pairs // self.width, self.pairs % self.width
        self.token_fold = self.fold[self.doc]

    def counts(self, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts (with the left-out share), and the left-out share's."""
        train = np.bincount(index[self.token_fold != HELD_OUT], minlength=n)
        return train.astype(np.uint32), np.bincount(index[self.token_fold == DEV], minlength=n).astype(np.uint32)


def pair_keys(words: list[str], chunk: Chunk) -> np.ndarray:
    import xxhash

    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    start = np.concatenate([np.array([0x5EED5EED5EED5EED], np.uint64), own])
    with np.errstate(over="ignore"):
        key = start[chunk.context] * np.uint64(0x9E3779B97F4A7C15) ^ own[chunk.word]
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return key ^ (key >> np.uint64(32))


def word_parts(words: list[str], parts: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w) % parts for w in words), np.int64, len(words))


def questions(parts: int):
    """A function for chunks: their words (kind 1) and bigrams (kind 2) with counts, by part."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk, words = Chunk(row["blob"]), unpack(row["words"])[0].decode().split(" ")
                train, dev = chunk.counts(chunk.stream, len(words))
                part = word_parts(words, parts)
                out = []
                for p in np.unique(part):
                    at = np.flatnonzero(part == p)
                    out.append((row["chunk"], 1, int(p), pack(" ".join([words[i] for i in at]).encode(), planes(train[at]), planes(dev[at])), None))
                yield rows_batch(out)
                train, dev = chunk.counts(chunk.pair_of, len(chunk.pairs))
                keys = pair_keys(words, chunk)
                order = np.argsort(keys)
                keys, train, dev = keys[order], train[order], dev[order]
                bounds = np.searchsorted(key_parts(keys, parts), np.arange(parts + 1))
                out = []
                for p in np.flatnonzero(np.diff(bounds)):
                    at = slice(bounds[p], bounds[p + 1])
                    out.append((row["chunk"], 2, int(p), pack(planes(np.diff(keys[at], prepend=np.uint64(0))), planes(train[at]), planes(dev[at])), None))
                yield rows_batch(out)

    return ask


def answer(key, table):
    """Sums over chunks of one part, sent back to each chunk; a row of kind 3 has the part's distinct training words."""
    kind = key[0].as_py()
    chunks = table["chunk"].to_pylist()
    asked = [unpack(b) for b in table["blob"].to_pylist()]
    counts = [(from_planes(a[1], np.uint32), from_planes(a[2], np.uint32)) for a in asked]
    if kind == 1:
        words = pa.array([w for a in asked for w in a[0].decode().split(" ")], pa.string())
        index = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    else:
        keys = np.concatenate([np.cumsum(from_planes(a[0], np.uint64), dtype=np.uint64) for a in asked])
        _, index = np.unique(keys, return_inverse=True)
    sums = [np.bincount(index, weights=np.concatenate([c[i] for c in counts])) for i in (0, 1)]
    out, at = [], 0
    for chunk, (own, _) in zip(chunks, counts, strict=True):
        mine = index[at : at + len(own)]
        at += len(own)
        out.append((chunk, kind, key[1].as_py(), pack(planes(sums[0][mine].astype(np.uint32)), planes(sums[1][mine].astype(np.uint32))), None))
    if kind == 1:
        out.append(("", 3, int((sums[0] > 0).sum()), b"", None))
    return pa.Table.from_batches([rows_batch(out)])


def enrich(parts: int):
    """A function for one chunk and its answers: the chunk with the counts of its words and bigrams."""

    def join(_, table):
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        chunk, words = Chunk(own["blob"]), unpack(own["words"])[0].decode().split(" ")
        got = {(r["kind"], r["part"]): [from_planes(x, np.uint32) for x in unpack(r["blob"])] for r in rows if r["kind"]}
        part = word_parts(words, parts)
        word_counts = np.zeros((2, len(words)), np.uint32)
        for p in np.unique(part):
            word_counts[:, part == p] = got[1, int(p)]
        order = np.argsort(pair_keys(words, chunk))
        pair_counts = np.zeros((2, len(order)), np.uint32)
        pair_counts[:, order] = np.concatenate([np.array(got[2, p]) for p in sorted(p for k, p in got if k == 2)], axis=1)
        blob = pack(*unpack(own["blob"]), *(planes(c) for c in (*word_counts, *pair_counts)))
        return pa.Table.from_batches([rows_batch([(own["chunk"], 0, own["part"], blob, None)])])

    return join


class Counted(Chunk):
    """An enriched chunk. ``starts``: training documents and those left out, the start's counts as a context."""

    def __init__(self, blob: bytes, starts: tuple[int, int]):
        super().__init__(blob)
        w, wd, p, pd = (from_planes(x, np.uint32).astype(np.float64) for x in unpack(blob)[5:])
        self.word_count, self.word_dev, self.pair_count, self.pair_dev = w, wd, p, pd
        self.context_count, self.context_dev = np.concatenate([[starts[0]], w]), np.concatenate([[starts[1]], wd])

    def estimates(self, n: int, v: int, left_out: int | None = None):
        """(bucket, unigram, ratio of bigram to unigram) of each distinct bigram; left_out: tokens taken out of n."""
        c1, ch, c2 = self.word_count, self.context_count, self.pair_count
        if left_out is not None:
            c1, ch, c2, n = c1 - self.word_dev, ch - self.context_dev, c2 - self.pair_dev, n - left_out
        unigram = ((c1 + 0.5) / (n + 0.5 * (v + 1)))[self.word]
        context = ch[self.context]
        bucket = np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)
        return bucket, unigram, np.divide(c2, context, out=np.zeros_like(c2), where=context > 0) / unigram


def em_weights(histogram: list, rounds: int = 100) -> np.ndarray:
    """Weights by bucket from rows (bucket, bin, tokens, sum of ratios)."""
    weights = np.zeros(BUCKETS)
    for b in range(1, BUCKETS):
        rows = [(n, s / n) for bucket, _, n, s in histogram if bucket == b]
        if not rows:
            continue
        n, r = np.array(rows).T
        x = 0.5
        for _ in range(rounds):
            x = float((n * (x * r / (x * r + 1 - x))).sum() / n.sum())
            x = min(max(x, 1e-6), 1 - 1e-6)
        weights[b] = x
    seen = np.flatnonzero(weights)
    for b in range(1, BUCKETS):  # a bucket that nothing was held out for takes the nearest weight
        if not weights[b]:
            weights[b] = weights[seen[np.argmin(abs(seen - b))]] if len(seen) else 0.5
    return weights


def score_documents(docs: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows. ``fold``: a column over ``doc_id`` with TRAIN, HELD_OUT or DEV.

    Columns of SCORE_SCHEMA, and train_tokens.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = materialize(named.select("doc_id", "text", fold.cast("int").alias("fold")).mapInArrow(encode, BLOB_SCHEMA), "lm-chunks")

    def count(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                _, _, fold, sizes, _ = unpack(blob)
                fold, sizes = np.frombuffer(fold, np.uint8), np.frombuffer(sizes, np.int64)
                train, dev = fold != HELD_OUT, fold == DEV
                got = [sizes.sum(), sizes[train].sum(), sizes[dev].sum(), train.sum(), dev.sum()]
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in got], names=["t", "n", "d", "s", "sd"])

    totals = chunks.select("blob").mapInArrow(count, "t long, n long, d long, s long, sd long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "n", "d", "s", "sd"))).first()
    tokens, n, left_out, *starts = (int(x) for x in totals)
    parts = max(partitions_for(docs), math.ceil(tokens / PART_TOKENS))
    asked = chunks.select("chunk", "blob", "words").mapInArrow(questions(parts), BLOB_SCHEMA)
    answers = materialize(asked.groupBy("kind", "part").applyInArrow(answer, BLOB_SCHEMA), "lm-answers")
    v = int(answers.filter("kind = 3").agg(F.coalesce(F.sum("part"), F.lit(0))).first()[0])
    counted = materialize(chunks.unionByName(answers.filter("kind < 3")).groupBy("chunk").applyInArrow(enrich(parts), BLOB_SCHEMA), "lm-counted")
    drop_scratch(chunks)
    drop_scratch(answers)

    def held_out(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                chunk = Counted(blob, tuple(starts))
                bucket, _, ratio = chunk.estimates(n, v, left_out)
                times = np.bincount(chunk.pair_of[chunk.token_fold == DEV], minlength=len(chunk.pairs))
                on = times > 0
                bucket, ratio, times = bucket[on], ratio[on], times[on]
                grade = np.where(ratio > 0, np.round(16 * np.log2(np.maximum(ratio, 1e-30))), -9999).astype(np.int64)
                keys, index = np.unique(bucket * 100_000 + grade + 20_000, return_inverse=True)
                sums = [np.bincount(index, weights=times), np.bincount(index, weights=times * ratio)]
                yield pa.RecordBatch.from_arrays([pa.array((keys // 100_000).astype(np.int32)), pa.array((keys % 100_000).astype(np.int32)), *map(pa.array, sums)], names=["bucket", "grade", "n", "s"])

    # at most BUCKETS times some thousand grades
    histogram = counted.select("blob").mapInArrow(held_out, "bucket int, grade int, n double, s double").groupBy("bucket", "grade").agg(F.sum("n"), F.sum("s")).collect()
    weights = em_weights([tuple(r) for r in histogram])

    def score(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                chunk = Counted(blob, tuple(starts))
                bucket, unigram, ratio = chunk.estimates(n, v)
                w = weights[bucket]
                of_pair = np.log10(unigram) + np.log10((1 - w) + w * ratio)
                per_doc = lambda x: np.bincount(chunk.doc, weights=x, minlength=len(chunk.ids))
                base = per_doc(np.log10(unigram)[chunk.pair_of])
                known = per_doc((chunk.word_count > 0)[chunk.stream].astype(np.float64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.ids, mask=chunk.null), pa.array(chunk.fold == HELD_OUT), pa.array(chunk.sizes), pa.array(known), pa.array(base), pa.array(per_doc(of_pair[chunk.pair_of]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return counted.select("blob").mapInArrow(score, SCORE_SCHEMA).withColumn("train_tokens", F.lit(n).cast("long"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; every fifth by the hash of its id is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text_id = F.col("doc_id").cast("string")
    held = F.coalesce(F.crc32(text_id.cast("binary")) % 5 == 1, F.lit(False))
    dev = F.coalesce(F.crc32(F.concat(F.lit("dev"), text_id).cast("binary")) % 8 == 0, F.lit(False))
    fold = F.when(held, HELD_OUT).when(dev, DEV).otherwise(TRAIN)
    return score_documents(docs, fold)
