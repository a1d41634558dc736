"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, of target rows (labelled good) and of all raw
rows, give every document the log importance weight ``sum over n-grams of log p_target -
log p_raw``; Gumbel noise keyed by the id makes the k largest perturbed weights a sample
without replacement in proportion to the weights. k is the number of rows whose weight is above a threshold
between good and bad labelled rows: the one that tells them best, where a good row lost counts as
``GOOD_WORTH`` bad ones kept, moved half-way down to the next lower labelled weight. So k follows from the
weights of all rows, whatever part of them is labelled. Every labelled row counts, in the target model and in the
threshold: their texts and weights meet the labels in joins that are dealt by the id, and the threshold is
found over a table of the distinct weights in order.

n-grams: words and word pairs (lower case), and runs of one to three word shapes (case and
punctuation patterns), hashed into ``buckets`` counts.

Nulls and empty texts have weight 0. Null ids take the noise of id null. Ties are ordered by
id and text hash; repeated rows tie in both and are then taken together, so more than k rows
can stay. Without good and bad labelled rows everything stays. An id that is labelled both good and
bad counts as bad. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.common import drop_scratch, materialize, maybe_among, partitions_for, row_key, sliced, small_batches

BUCKETS = 10_000
#: Bad rows kept that count as much as one good row lost.
GOOD_WORTH = 10
#: Longest token kept with its hashes.
KEPT_LENGTH = 64
SHAPES = [(re.compile(p), r) for p, r in ((r"[^\W\d_]+", lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "C" if m[0][0].isupper() else "x"), (r"\d+", "9"))]


def shape(token: str) -> str:
    for pattern, by in SHAPES:
        token = pattern.sub(by, token)
    return token


class TokenTable:
    """Hashes of each distinct token, kept over batches up to a size."""

    def __init__(self, most: int = 100_000):
        self.most, self.known = most, {}

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.known = {}
        known, words, shapes = self.known, np.empty(len(tokens), np.uint64), np.empty(len(tokens), np.uint64)
        for i, token in enumerate(tokens):
            got = known.get(token)
            if got is None:
                got = (zlib.crc32(token.lower().encode()), zlib.crc32(shape(token).encode(), 7))
                if len(token) <= KEPT_LENGTH:
                    known[token] = got
            words[i], shapes[i] = got
        return words, shapes


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


def features(texts: pa.Array, table: TokenTable, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of a batch of texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        flat, rows = flat.filter(pa.array(full)), rows[full]
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    enc = flat.dictionary_encode()
    ix = enc.indices.to_numpy()
    words, shapes = (x[ix] for x in table.look_up(enc.dictionary.to_pylist()))
    two, three = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
    p, q = np.uint64(0x1000003), np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        parts = [
            (rows, words + np.uint64(1 << 40)),
            (rows[1:][two], (words[:-1] * p + words[1:] + np.uint64(1 << 41))[two]),
            (rows, shapes + np.uint64(1 << 42)),
            (rows[1:][two], (shapes[:-1] * p + shapes[1:] + np.uint64(1 << 43))[two]),
            (rows[2:][three], (shapes[:-2] * q + shapes[1:-1] * p + shapes[2:] + np.uint64(1 << 44))[three]),
        ]
        return np.concatenate([r for r, _ in parts]), np.concatenate([(mixed(h) % np.uint64(buckets)).astype(np.int64) for _, h in parts])


def count_ngrams(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of the n-grams of column ``text``: a vector of ``buckets`` summed over all tasks."""

    def count(batches):
        table, sums = TokenTable(), np.zeros(buckets, np.int64)
        for batch in sliced(batches, "text"):
            sums += np.bincount(features(batch.column("text"), table, buckets)[1], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    got = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        got[bucket] = n
    return got


def radix_cut(rows: DataFrame, column: str, k: int) -> tuple[int, int, int] | None:
    """The k-th largest value of a long column, found by four counts of 16 bits each; how many rows have it, and how many of those are among the k.

    None if there are not more than k rows.
    """
    low, width, left, times = -(1 << 63), 1 << 64, k, 0
    for _ in range(4):
        width >>= 16
        top = rows.filter((F.col(column) >= low) & (F.col(column) <= low + (width << 16) - 1)) if width < 1 << 48 else rows
        part = F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(-(1 << 63)).cast("long")), width.bit_length() - 1).bitwiseAND(F.lit(0xFFFF))
        counts = dict(top.groupBy(part.alias("b")).count().collect())  # 65,536 rows at most
        if width == 1 << 48 and sum(counts.values()) <= k:
            return None
        for b in sorted(counts, reverse=True):
            if counts[b] >= left:
                break
            left -= counts[b]
        low, times = low + b * width, counts[b]
    return low, times, left


def largest(rows: DataFrame, columns: list[str], k: int) -> Column:
    """A condition that holds for the k largest rows by long columns; rows that tie in all of them are taken together."""
    kept, tied, left = F.lit(False), F.lit(True), k
    for column in columns:
        cut = radix_cut(rows, column, left)
        if cut is None:
            return kept | tied
        value, times, left = cut
        kept = kept | (tied & (F.col(column) > F.lit(value)))
        tied = tied & (F.col(column) == F.lit(value))
        if times == left:
            break
        rows = rows.filter(F.col(column) == F.lit(value))
    return kept | tied


def threshold(good: np.ndarray, bad: np.ndarray, worth: float = GOOD_WORTH) -> float:
    """The weight that best tells good from bad rows, half-way to the next lower labelled weight; of equals the lowest. For weights in memory, see :func:`table_threshold`."""
    values = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(np.sort(good), values) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), values) / len(bad)
    best = int(np.argmin(worth * lost + kept))
    return float(values[best] if best == 0 else (values[best] + values[best - 1]) / 2)


def table_threshold(told: DataFrame, worth: float = GOOD_WORTH) -> float | None:
    """:func:`threshold` of all rows (w, good) of a table, None without good or without bad ones.

    The distinct weights are written in ranges; the driver sees one row a range.
    """
    counts = told.groupBy("w").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    cuts = materialize(counts.repartitionByRange(partitions_for(told), "w").withColumn("range", F.spark_partition_id()), "quality-weights")
    ranges = cuts.groupBy("range").agg(F.sum("g"), F.sum("b"), F.max("w")).orderBy("range").collect()
    before, goods, bads, last = [], 0, 0, None
    for at, g, b, w in ranges:
        before.append((at, goods, bads, last))
        goods, bads, last = goods + g, bads + b, w
    if not goods or not bads:
        return None
    order = Window.partitionBy("range").orderBy("w")
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    lost = (F.col("g0") + F.coalesce(F.sum("g").over(lower), F.lit(0))) / F.lit(float(goods))
    kept = 1 - (F.col("b0") + F.coalesce(F.sum("b").over(lower), F.lit(0))) / F.lit(float(bads))
    firsts = told.sparkSession.createDataFrame(before, "range int, g0 long, b0 long, w0 double")
    cost = cuts.join(F.broadcast(firsts), "range").select((worth * lost + kept).alias("cost"), "w", F.coalesce(F.lag("w").over(order), "w0").alias("next"))
    best = cost.agg(F.min(F.struct("cost", "w", "next")).alias("x")).first().x
    drop_scratch(cuts)
    return best.w if best.next is None else (best.w + best.next) / 2


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = 1) -> DataFrame:
    """Scores of every row: _k1, _k2, doc_id, log_weight, gumbel_key, selected."""
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.min("quality") > 0).alias("good"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # dealt by the id at any size, so that nothing that grows with the labels is broadcast; an inner join, as Spark would
    # push a semi join below the filter, which leaves most texts without a good label where they are
    good = known.filter("good").select("_id")
    target = count_ngrams(maybe_among(texts, good, ["_id"]).join(good.hint("shuffle_hash"), "_id"), buckets)
    raw = count_ngrams(texts, buckets)
    if not target.sum():
        ratio = np.zeros(buckets)
    else:
        ratio = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))

    def score(batches):
        table = TokenTable()
        for batch in sliced(batches, "text"):
            at, got = features(batch.column("text"), table, buckets)
            sums = np.bincount(at, weights=ratio[got], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), batch.column("doc_id"), pa.array(np.round(sums, 9))], names=["_k1", "_k2", "doc_id", "log_weight"])

    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    scored = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = scored.mapInArrow(score, "_k1 long, _k2 long, doc_id long, log_weight double")
    scored = scored.withColumn("gumbel_key", F.round(F.col("log_weight") - F.log(-F.log(u)), 9))
    # exact order of the keys as integers: nine decimals of a double
    scored = materialize(scored.withColumn("o", F.round(F.col("gumbel_key") * 1e9).cast("long")), "quality-scores")
    # one weight for each labelled id
    told = scored.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), "log_weight").join(known.hint("shuffle_hash"), "_id").groupBy("_id", "good").agg(F.min("log_weight").alias("w"))
    limit = table_threshold(told.select("w", "good"))
    if limit is None:
        kept = F.lit(True)
    else:
        k = scored.filter(F.col("log_weight") >= limit).count()
        order = scored.withColumns({"_a": F.bitwise_not("_k1"), "_b": F.bitwise_not("_k2")})  # of ties the least ids
        scored, kept = order, largest(order, ["o", "_a", "_b"], k) if k else F.lit(False)
    return scored.select("_k1", "_k2", "doc_id", "log_weight", "gumbel_key", kept.alias("selected"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, key and decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels).select("doc_id", "log_weight", "gumbel_key", "selected")
