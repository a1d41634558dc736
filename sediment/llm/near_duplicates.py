"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (a text of one to four words is one shingle). Equal
sets form a class; all further work is on one representative a class.

Candidates share one of ``BANDS`` band keys of ``ROWS`` MinHash values each: a pair at the
threshold itself is missed with probability (1 - 0.8^4)^40 = 7e-10, closer pairs with less.
Representatives that share a key with any other are grouped by components of the candidate graph; a component of
more than ``BLOCK`` of them, or ``BLOCK_BYTES`` of their shingles, is cut into blocks. A representative is sent to its own block and
to those others in which one shares a key with it, so what is sent follows the candidates
and not the square of a component. A pair of blocks is compared in one task: band keys first, then MinHash values
32 at a time, dropping a pair as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold is under ``TOLERANCE``; what is left is counted exactly.

Every row gets its group (component of verified links), its class and its number of links to
other rows, copies included. Pairs never become rows.

Nulls and texts without words have no shingles, no links and a group of their own, named by their own id. Rows
with a null id take part like others; their class and group are named by the least id there, null if all of them are null. Repeated
rows are copies of each other. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import drop_scratch, materialize, maybe_among, row_key, sliced, small_batches
from sediment.llm.components import connected_components
from sediment.llm.exchange import pack, unpack

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-9
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Pairs whose MinHash values are compared at once.
SLAB = 1 << 15

_MULTIPLIERS = (np.random.default_rng(20).integers(1, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP ...: the least number of equal values with which a pair goes on.

    With a uniform prior P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    plain = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    flat, parents = flat.filter(full), parents.filter(full).to_numpy()
    if not len(flat):
        return [np.empty(0, np.uint64)] * len(texts)
    import xxhash

    enc = flat.dictionary_encode()
    words = np.fromiter((xxhash.xxh64_intdigest(w) for w in enc.dictionary.to_pylist()), np.uint64, len(enc.dictionary))[enc.indices.to_numpy()]
    sizes = np.bincount(parents, minlength=len(texts))
    ends = np.cumsum(sizes)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    with np.errstate(over="ignore"):
        wide = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
        hashed = wide[: len(words)].copy()
        for j in range(1, SHINGLE):
            hashed = hashed * a + wide[j : j + len(words)]
            hashed ^= hashed >> np.uint64(29)
        hashed *= b
        hashed ^= hashed >> np.uint64(32)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        start = end - n
        if n >= SHINGLE:
            out.append(np.unique(hashed[start : end - SHINGLE + 1]))
        elif n:
            out.append(np.array([int.from_bytes(hashlib.blake2b(words[start:end].tobytes(), digest_size=8).digest(), "little")], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (uint32) of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((flat * _MULTIPLIERS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    with np.errstate(over="ignore"):
        v = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64) + np.uint64(0x1234567)
        for r in range(ROWS):
            key = (key ^ v[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def class_of(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64).tolist())


ROW_SCHEMA = "_k1 long, _k2 long, doc_id long, c1 long, c2 long, n int, keys array<long>"


def describe(batches):
    """Class, size and band keys of each row."""
    for batch in sliced(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        classes = [class_of(s) for s in sets]
        some = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if some:
            for i, k in zip(some, band_keys(signatures([sets[i] for i in some])), strict=True):
                keys[i] = k
        c1, c2 = zip(*classes, strict=True)
        cols = [*(batch.column(c) for c in ("_k1", "_k2", "doc_id")), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in ROW_SCHEMA.split(", ")])


MEMBER_SCHEMA = "node long, component long, block int, others array<int>, weight long, body binary"


def carry(batches):
    """Shingles and MinHash values of each representative."""
    for batch in sliced(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        values = signatures(sets)
        body = [pack(s, v) for s, v in zip(sets, values, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "component", "block", "others", "weight")), pa.array(body, pa.binary())], names=[f.split()[0] for f in MEMBER_SCHEMA.split(", ")])


class Block:
    def __init__(self, rows: list[dict]):
        self.nodes, self.weights = np.array([r["node"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.int64)
        bodies = [unpack(r["body"]) for r in rows]
        self.sets = [np.frombuffer(b[0], np.uint64) for b in bodies]
        self.sizes = np.array([len(s) for s in self.sets])
        self.values = np.array([np.frombuffer(b[1], np.uint32) for b in bodies], np.uint32).reshape(-1, HASHES)
        self.keys = band_keys(self.values)


def candidates(a: Block, b: Block, least: list[int], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) that share a band key and survive the pruning."""
    shared = np.zeros((len(a.nodes), len(b.nodes)), bool)
    for k in range(BANDS):
        shared |= a.keys[:, k, None] == b.keys[None, :, k]
    shared &= np.minimum(a.sizes[:, None], b.sizes[None, :]) >= threshold * np.maximum(a.sizes[:, None], b.sizes[None, :]) - 1e-9
    if same:
        shared &= np.triu(np.ones_like(shared), 1)
    i, j = np.nonzero(shared)
    left = [pruned(a, b, i[low : low + SLAB], j[low : low + SLAB], least) for low in range(0, len(i), SLAB)] or [(i, j)]
    return np.concatenate([x for x, _ in left]), np.concatenate([y for _, y in left])


def pruned(a: Block, b: Block, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are not dropped while their MinHash values are compared."""
    equal = np.zeros(len(i), np.int64)
    for step, need in enumerate(least):
        at = slice(step * STEP, (step + 1) * STEP)
        equal += (a.values[i, at] == b.values[j, at]).sum(axis=1)
        on = equal >= need
        i, j, equal = i[on], j[on], equal[on]
    return i, j


def overlaps(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact numbers of common shingles of pairs."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(a.sets[x], b.sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    left, right = np.unique(i), np.unique(j)
    flats = [np.concatenate([blk.sets[k] for k in rows]) for blk, rows in ((a, left), (b, right))]
    owners = [np.repeat(np.arange(len(rows)), [len(blk.sets[k]) for k in rows]) for blk, rows in ((a, left), (b, right))]
    common = np.intersect1d(np.unique(flats[0]), np.unique(flats[1]))
    total = np.zeros((len(left), len(right)), np.float32)
    where = [np.searchsorted(common, f) for f in flats]
    hit = [(w < len(common)) & (common[np.minimum(w, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for w, f in zip(where, flats, strict=True)]
    for low in range(0, len(common), 8192):
        dense = []
        for w, h, o, n in zip(where, hit, owners, (len(left), len(right)), strict=True):
            m = np.zeros((n, min(8192, len(common) - low)), np.float32)
            on = h & (w >= low) & (w < low + 8192)
            m[o[on], w[on] - low] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return np.rint(total[np.searchsorted(left, i), np.searchsorted(right, j)]).astype(np.int64)


LINK_SCHEMA = "a long, b long, links long"


def compare(threshold: float):
    """A function for a pair of blocks: (node, node, links) rows for links of each node, and (a, b, null) for a forest of the linked nodes."""
    least = fewest_matches(threshold)

    def links(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        rows = list({r["node"]: r for r in table.to_pylist()}.values())  # repeated rows carry one text twice
        a = Block([r for r in rows if r["block"] == low])
        same = low == high
        b = a if same else Block([r for r in rows if r["block"] == high])
        out: list[tuple] = []
        if len(a.nodes) and len(b.nodes):
            i, j = candidates(a, b, least, threshold, same)
            common = overlaps(a, b, i, j)
            union = a.sizes[i] + b.sizes[j] - common
            on = common >= threshold * union - 1e-9
            i, j = i[on], j[on]
            ends = np.concatenate([a.nodes[i], b.nodes[j]])
            counts = np.concatenate([b.weights[j], a.weights[i]])
            nodes, index = np.unique(ends, return_inverse=True)
            out += [(int(x), int(x), int(n)) for x, n in zip(nodes, np.bincount(index, weights=counts), strict=True)]
            parent = {int(x): int(x) for x in nodes}

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in zip(a.nodes[i].tolist(), b.nodes[j].tolist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((x, y, None))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: _k1, _k2, doc_id, class_id, group_id, n_links, keep.

    class_id: the least doc_id with an equal shingle set; group_id: the least doc_id of the
    connected documents; keep: true for one row of each group (the least id, then text hash).
    """
    small_batches(docs.sparkSession)
    texts = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(describe, ROW_SCHEMA), "near-rows")
    # one representative a class: its least (id, hash) stands for it, null ids last; node is a number of its own for the graph
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "_k1", "_k2")).alias("rep")
    whole = rows.filter("n > 0").groupBy("c1", "c2").agg(first, F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    classes = materialize(whole.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    pairs = classes.select("node", F.explode("keys").alias("key"))
    buckets = pairs.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "low")
    shared = materialize(pairs.join(buckets, "key"), "near-shared")
    edges = materialize(shared.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "near-edges")
    parts = materialize(connected_components(edges), "near-candidates")
    body = F.col("n").cast("long") * 8 + HASHES * 4
    placed = parts.join(classes.select("node", "weight", "rep._k1", "rep._k2", body.alias("bytes")), "node")
    sizes = placed.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = materialize(placed.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("bytes"), "near-placed")
    # where a large component's representatives meet candidates
    large = shared.select("node", "key").join(placed.filter("blocks > 1").select("node", "block"), "node")
    there = large.select("key", F.col("block").alias("other")).distinct()
    targets = large.join(there, "key").groupBy("node").agg(F.collect_set("other").alias("others"))
    chosen = placed.join(targets, "node", "left").select("node", "component", "block", "weight", "_k1", "_k2", F.coalesce("others", F.array("block")).alias("others"))
    chosen = materialize(chosen, "near-chosen")
    bodies = maybe_among(texts.select("_k1", "_k2", "text"), chosen, ["_k1", "_k2"]).join(chosen, ["_k1", "_k2"])
    members = bodies.select("node", "component", "block", "others", "weight", "text").mapInArrow(carry, MEMBER_SCHEMA)
    sent = members.withColumn("other", F.explode("others")).select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "weight", "body")
    links = materialize(sent.groupBy("component", "low", "high").applyInArrow(compare(threshold), LINK_SCHEMA), "near-links")
    counts = links.filter("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = materialize(connected_components(links.filter("links IS NULL").select("a", "b")), "near-groups")
    graded = materialize(classes.join(counts, "node", "left").join(groups, "node", "left").select("c1", "c2", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"), "rep"), "near-graded")
    heads = graded.groupBy("component").agg(F.min("rep").alias("head"))
    graded = materialize(graded.join(heads, "component").select("c1", "c2", "weight", "links", "rep", "head"), "near-classes-graded")
    for done in (classes, shared, edges, parts, placed, chosen, links, groups):
        drop_scratch(done)
    out = rows.select("_k1", "_k2", "doc_id", "c1", "c2", "n").join(graded, ["c1", "c2"], "left")
    alone = F.col("head").isNull()
    return out.select(
        "_k1", "_k2", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("weight") - 1 + F.col("links")).cast("long").alias("n_links"),
        F.when(alone, F.lit(True)).otherwise((F.col("_k1") == F.col("head._k1")) & (F.col("_k2") == F.col("head._k2"))).alias("keep"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, classes and numbers of links of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "group_id", "n_links")


OP4_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), z AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS c FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 5 * k >= 4 * (za.n + zb.n - k)
), r(a, b) AS (SELECT doc_id, doc_id FROM z UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), grp AS (SELECT a, min(b) AS group_id FROM r GROUP BY a
), cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id FROM z
), cnt AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(group_id, w.doc_id) AS group_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN cls ON cls.doc_id = w.doc_id LEFT JOIN grp ON grp.a = w.doc_id LEFT JOIN cnt ON cnt.a = w.doc_id
"""
