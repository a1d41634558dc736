"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are ``[0-9a-z]`` and non-ASCII runs after lower-casing A-Z. Texts are cut into
segments of ``SEGMENT`` words that overlap by ``window - 1`` words. In every segment the least
k-gram hash of each run of ``window - k + 1`` k-grams is kept (the rightmost of equals), so that
each shared run of ``window`` words leaves the same fingerprint on both sides. Fingerprints
are joined and every hit is extended by at most ``window - k`` words to both sides on the words
themselves; ``window`` equal words make it an occurrence. Items shorter than ``window`` are
joined whole, once for each length that occurs.

Nulls and texts without words have no words and no hits; null ids are kept as rows of their
own. Repeated documents are counted by id and text, so each gives its row. Repeated items
and empty tables are fine. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import materialize, row_key

WINDOW, K = 10, 5
SEGMENT = 64
#: Largest number of fingerprint rows that are broadcast (about 200 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 50_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: str) -> Column:
    """Words of a text column; null gives an empty array."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def segments(rows: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Segments of at most SEGMENT + window - 1 words: columns ``start`` and ``w``."""
    cut = F.expr(f"if(size(words) < {window}, null, transform(sequence(0, size(words) - {window}, {SEGMENT}), s -> named_struct('start', s, 'w', slice(words, s + 1, {SEGMENT + window - 1}))))")
    # explode_outer: a plain explode infers a filter on the array's size, which is pushed down and computes everything twice
    return rows.select(*keys, F.explode_outer(cut).alias("seg")).select(*keys, "seg.start", "seg.w").filter("start IS NOT NULL")


def fingerprints(cut: DataFrame, keys: list[str], window: int, k: int) -> DataFrame:
    """One row for each kept k-gram: its hash, its position in the text, and up to window - k words on both sides."""
    wide, around = window - k + 1, window - k
    gram = ", ".join(f"h[i + {j}]" for j in range(k))
    run = ", ".join(f"p[i + {j}]" for j in range(wide))
    # the low 7 bits of a hash give way to the position, so that one least() finds the rightmost least hash
    out = cut.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    out = out.withColumn("p", F.expr(f"transform(sequence(0, size(w) - {k}), i -> (xxhash64({gram}) & -128L) | (127 - i))"))
    out = out.withColumn("f", F.expr(f"array_distinct(transform(sequence(0, size(p) - {wide}), i -> least({run})))"))
    out = out.select(*keys, "start", "w", F.explode_outer("f").alias("f"))
    out = out.withColumn("i", (127 - F.col("f").bitwiseAND(127)).cast("int"))
    return out.select(
        *keys,
        F.col("f").bitwiseAND(-128).alias("h"),
        (F.col("start") + F.col("i")).alias("at"),
        F.expr(f"reverse(slice(w, greatest(i - {around}, 0) + 1, least(i, {around})))").alias("before"),
        F.expr(f"slice(w, i + 1, {k + around})").alias("after"),
    )


def same_prefix(a: str, b: str) -> str:
    """SQL for the number of equal leading elements of two arrays."""
    return f"coalesce(nullif(array_position(transform(sequence(1, greatest(1, least(size({a}), size({b})))), j -> coalesce(get({a}, j - 1) = get({b}, j - 1), false)), false), 0) - 1, least(size({a}), size({b})))"


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Occurrences: _k1, _k2, s, e (word range of a document, end excluded), items (array of item ids).

    ``docs`` has _k1, _k2 and words; ``items`` has item_id and words.
    """
    keys = ["_k1", "_k2"]
    long_items = fingerprints(segments(items.filter(F.size("words") >= window), ["item_id"], window), ["item_id"], window, k)
    index = materialize(long_items.groupBy("h", F.col("before").alias("b_before"), F.col("after").alias("b_after")).agg(F.collect_set("item_id").alias("items")), "benchmark-index")
    found = fingerprints(segments(docs, keys, window), keys, window, k).join(small(index), "h")
    left, right = same_prefix("before", "b_before"), same_prefix("after", "b_after")
    found = found.select(*keys, "at", "items", F.expr(left).alias("l"), F.expr(right).alias("r"))
    out = found.filter((F.col("r") >= k) & (F.col("l") + F.col("r") >= window))
    out = out.select(*keys, (F.col("at") - F.col("l")).cast("int").alias("s"), (F.col("at") + F.col("r")).cast("int").alias("e"), "items")
    short = materialize(items.filter((F.size("words") > 0) & (F.size("words") < window)).groupBy("words").agg(F.collect_set("item_id").alias("items")), "benchmark-short")
    for (n,) in short.select(F.size("words").alias("n")).distinct().orderBy("n").collect():
        # every position's n-gram is looked up by its hash, then by its words
        own = short.filter(F.size("words") == n).select(F.xxhash64("words").alias("h"), F.col("words").alias("item_words"), "items")
        gram = F.expr(f"explode_outer(transform(sequence(0, size(w) - {n}), i -> named_struct('i', i, 'g', slice(w, i + 1, {n}))))")
        pieces = segments(docs.filter(F.size("words") >= n), keys, n).select(*keys, "start", gram.alias("x"))
        pieces = pieces.select(*keys, (F.col("start") + F.col("x.i")).cast("int").alias("s"), F.col("x.g").alias("g"), F.xxhash64("x.g").alias("h")).join(small(own), "h").filter("g = item_words")
        out = out.unionByName(pieces.select(*keys, "s", (F.col("s") + n).cast("int").alias("e"), "items"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Per document: _k1, _k2, doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    items = benchmark.select("item_id", words("text").alias("words"))
    found = hits(texts.select("_k1", "_k2", words("text").alias("words")), items, window, k)
    # ranges once each, then their union by a fold over the sorted ranges of one document
    ranges = found.groupBy("_k1", "_k2", "s", "e").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    per_doc = ranges.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'e', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(x.s, a.e)), 'e', greatest(a.e, x.e)), a -> a.n)")
    per_doc = materialize(per_doc.select("_k1", "_k2", covered.alias("n_hit"), F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("item_ids"), "spans"), "contaminated")
    counted = texts.select("_k1", "_k2", "doc_id", F.size(words("text")).cast("long").alias("n_words"))
    out = counted.join(per_doc, ["_k1", "_k2"], "left")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))).withColumn("n_items", F.size("item_ids").cast("long"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, benchmark)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(len(w) - least(10, len(w)) + 1), lambda i: list_slice(w, i + 1, i + least(10, len(w))))) AS g FROM b WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT k, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS g FROM (SELECT k, n, w, unnest(range(len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT k, i, dw.n, item_id FROM dw JOIN (SELECT DISTINCT item_id, n, array_to_string(g, ' ') AS g FROM bw) x USING (n, g)
), c AS (
  SELECT k, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k
), t AS (
  SELECT k, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
