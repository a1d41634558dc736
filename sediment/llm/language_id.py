"""Language identification of words in code-switched text by a linear-chain CRF.

Labels are the languages of the training rows. A word's emission scores are sums of learned
weights of hashed features: its prefixes and suffixes of one to three letters, its letter
bigrams and trigrams with borders, and a lexicon feature (the word itself). Transitions
between the labels of neighbouring words are learned too, from training sequences spliced of
runs of words from documents of different languages. Texts are labelled by forward-backward:
each word gets marginal probabilities, and the document the language with the largest mean
marginal over its words with letters, which is also the score.

The model is fitted on the driver on at most TRAIN_DOCS labelled documents, on all words of
each; prediction reads whole texts, too. Every language gets the same number of documents, those
with the least hashes, or all it has; equal rows count once. Each language of the training rows
is a label (if there are more than TRAIN_DOCS, each has one document). Forward
and backward passes run on fixed-size blocks side by side: a first pass gives each block's
transfer matrix, these are chained, a second pass starts each block from its true state.

A null text, or one without letters, is ``und`` with score 0. Without training rows all are ``und``.
Repeated rows give one row each, with equal values. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.common import sliced, small_batches

BUCKETS = 1 << 16
#: Bound of the training sample: labelled documents, each with all its words.
TRAIN_DOCS = 3000
SEQUENCE = 40
EPOCHS, BATCH, RATE = 4, 64, 0.5
WIDE = 128  # words of a block
LETTERS = re.compile(r"[^\W\d_]+")
OUT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def bare(token: str) -> str:
    """The letters of a token, lower case; empty if it has none."""
    return "".join(LETTERS.findall(token)).lower()


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature of non-empty words, all at once over their code points."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    start = np.cumsum(sizes + 2) - sizes - 1  # first letter
    end = start + sizes  # after the last letter
    p = np.uint64(0x100000001B3)
    found = []
    with np.errstate(over="ignore"):
        two = points[:-1] * p + points[1:]
        three = two[:-1] * p + points[2:]
        same = owner[1:] == owner[:-1]
        found.append((owner[1:][same], mixed(two[same], 1)))
        same = owner[2:] == owner[:-2]
        found.append((owner[2:][same], mixed(three[same], 2)))
        for n, grams in ((1, points), (2, two), (3, three)):
            long_enough = np.flatnonzero(sizes >= n)
            found.append((long_enough, mixed(grams[start[long_enough]], 2 + n)))
            found.append((long_enough, mixed(grams[end[long_enough] - n], 5 + n)))
        place = np.arange(len(points)) - np.repeat(start - 1, sizes + 2)
        powers = np.cumprod(np.full(int(sizes.max()) + 2, p, np.uint64))
        found.append((np.arange(len(words)), mixed(np.add.reduceat(points * powers[place], start - 1), 9)))
    return np.concatenate([w for w, _ in found]), (np.concatenate([h for _, h in found]) % np.uint64(BUCKETS)).astype(np.int64)


def forward_backward(emit: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals of each label at each word.

    emit: words x labels, factors above 0; first: words that begin a sequence; start, move:
    probability-like factors of the first label and of moves.
    """
    n, k = emit.shape
    blocks = -(-n // WIDE)
    pad = blocks * WIDE - n
    e = np.concatenate([emit, np.ones((pad, k))]).reshape(blocks, WIDE, k)
    begin = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, WIDE)

    def chained(step, order, edge):
        """State before each block, from the blocks' transfer matrices."""
        m = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in order:
            m = step(m, t)
            m /= m.sum(axis=(1, 2), keepdims=True)
        state, out = edge, np.empty((blocks, k))
        for b in range(blocks) if order[0] == 0 else range(blocks - 1, -1, -1):
            out[b] = state
            state = state @ m[b]
            state = state / state.sum()
        return out

    def ahead(m, t):
        moved = m @ move
        reset = m.sum(axis=-1, keepdims=True) * start
        return np.where(begin[:, t].reshape(-1, *[1] * (m.ndim - 1)), reset, moved) * (e[:, t] if m.ndim == 2 else e[:, t, None, :])

    alpha = np.empty_like(e)
    now = chained(ahead, range(WIDE), np.full(k, 1 / k))
    for t in range(WIDE):
        now = ahead(now, t)
        now = now / now.sum(axis=1, keepdims=True)
        alpha[:, t] = now

    # backward: the state at t is what follows word t; crossing the start of a sequence forgets it
    def back(m, t):
        held = m * (e[:, t] if m.ndim == 2 else e[:, t, None, :])
        moved = held @ move.T
        reset = np.broadcast_to((held * start).sum(axis=-1, keepdims=True), held.shape)
        return np.where(begin[:, t].reshape(-1, *[1] * (m.ndim - 1)), reset, moved)

    beta = np.empty_like(e)
    now = chained(back, range(WIDE - 1, -1, -1), np.full(k, 1 / k))
    for t in range(WIDE - 1, -1, -1):
        beta[:, t] = now
        now = back(now, t)
        now = now / now.sum(axis=1, keepdims=True)
    both = (alpha * beta).reshape(-1, k)[:n]
    return both / both.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels, self.weights = labels, np.zeros((BUCKETS, k), np.float32)
        self.start, self.move = np.zeros(k), np.zeros((k, k))

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words; a word without letters says nothing."""
        out = np.zeros((len(words), len(self.labels)))
        some = np.array([i for i, w in enumerate(words) if w], np.int64)
        if len(some):
            of, bucket = features_of([words[i] for i in some])
            for k in range(len(self.labels)):
                out[some, k] = np.bincount(of, weights=self.weights[bucket, k], minlength=len(some))
        return out


def spliced(rows: list[tuple[list[str], int]], rng) -> list[tuple[list[str], list[int]]]:
    """Training sequences: runs of 5 to 20 words, half of the time followed by another row's."""
    cursor, out = [0] * len(rows), []
    alive = [i for i, (w, _) in enumerate(rows) if w]
    while alive:
        words, labels = [], []
        i = alive[rng.integers(len(alive))]
        while len(words) < SEQUENCE and alive:
            n = min(int(rng.integers(5, 21)), SEQUENCE - len(words))
            took = rows[i][0][cursor[i] : cursor[i] + n]
            cursor[i] += n
            words += took
            labels += [rows[i][1]] * len(took)
            if cursor[i] >= len(rows[i][0]):
                alive.remove(i)
                if not alive:
                    break
                i = alive[rng.integers(len(alive))]
            elif rng.random() < 0.2:
                i = alive[rng.integers(len(alive))]
        out.append((words, labels))
    if len(out) > 1 and len(out[-1][0]) < SEQUENCE:  # the last is filled up from the one before
        out[-1] = tuple((before + last)[-SEQUENCE:] for before, last in zip(out[-2], out[-1], strict=True))
    return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """CRF by gradient ascent on the likelihood of spliced sequences (AdaGrad on all weights)."""
    labels = sorted({lang for _, lang in rows})
    model, rng = Model(labels), np.random.default_rng(7)
    if len(labels) < 2:
        return model
    letters: dict[str, str] = {}

    def lettered(text):
        return [w for w in (letters[t] if t in letters else letters.setdefault(t, bare(t)) for t in text.split()) if w]

    sequences = [s for s in spliced([(lettered(text), labels.index(lang)) for text, lang in rows], rng) if s[0]]
    if not sequences:
        return model
    words = sorted({w for s, _ in sequences for w in s})
    number = {w: i for i, w in enumerate(words)}
    of, bucket = features_of(words)
    bucket, times = bucket[np.argsort(of, kind="stable")], np.bincount(of)
    begin = np.cumsum(times) - times  # the features of word w are bucket[begin[w] : begin[w] + times[w]]
    k = len(labels)
    weights, seen = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-2)
    start, move, seen_start, seen_move = np.zeros(k), np.zeros((k, k)), np.full(k, 1e-2), np.full((k, k), 1e-2)
    same = min(len(s) for s, _ in sequences)
    ids = np.array([[number[w] for w in s[:same]] for s, _ in sequences])
    gold = np.array([y[:same] for _, y in sequences])
    eye = np.eye(k)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // BATCH)):
            y = eye[gold[at]]
            there, x = np.unique(ids[at], return_inverse=True)
            many = times[there]
            edge = np.cumsum(many) - many
            touched, feature = np.unique(bucket[np.repeat(begin[there] - edge, many) + np.arange(many.sum())], return_inverse=True)
            score = np.add.reduceat(weights[touched][feature], edge)[x.reshape(len(at), same)]
            emit = np.exp(score - score.max(axis=2, keepdims=True))
            a, b = np.exp(start - start.max()), np.exp(move - move.max())
            alpha, beta, pair = np.empty_like(emit), np.empty_like(emit), np.zeros((k, k))
            for t in range(same):
                now = a * emit[:, 0] if t == 0 else (now @ b) * emit[:, t]
                now = now / now.sum(axis=1, keepdims=True)
                alpha[:, t] = now
            now = np.ones((len(at), k))
            for t in range(same - 1, -1, -1):
                beta[:, t] = now
                if t:
                    joint = alpha[:, t - 1, :, None] * b * (emit[:, t] * now)[:, None, :]
                    pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                    now = (emit[:, t] * now) @ b.T
                    now = now / now.sum(axis=1, keepdims=True)
            marginal = alpha * beta
            marginal /= marginal.sum(axis=2, keepdims=True)
            error = y - marginal
            of_words = np.stack([np.bincount(x.ravel(), weights=error[..., j].ravel()) for j in range(k)], axis=1)
            of_features = np.repeat(of_words, many, axis=0)
            grad = np.stack([np.bincount(feature, weights=of_features[:, j]) for j in range(k)], axis=1) / len(at)
            seen[touched] += grad**2
            weights[touched] += RATE * grad / np.sqrt(seen[touched])
            g = error[:, 0].sum(axis=0) / len(at)
            seen_start += g**2
            start += RATE * g / np.sqrt(seen_start)
            g = (np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:]) - pair) / len(at)
            seen_move += g**2
            move += RATE * g / np.sqrt(seen_move)
    model.weights, model.start, model.move = weights.astype(np.float32), start, move
    return model


def label_words(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, has letters, marginals) of each word of a batch of texts."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    flat, rows = flat.filter(full), rows.filter(full).to_numpy()
    k = len(model.labels)
    if not len(flat):
        return rows, np.empty(0, bool), np.empty((0, k))
    enc = flat.dictionary_encode()
    words = [bare(t) for t in enc.dictionary.to_pylist()]
    lettered, score = np.array([bool(w) for w in words]), model.scores(words)
    ix = enc.indices.to_numpy()
    emit = np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-30)[ix]
    first = np.append(True, rows[1:] != rows[:-1])
    start, move = np.exp(model.start - model.start.max()), np.exp(model.move - model.move.max())
    return rows, lettered[ix], forward_backward(emit, first, start, move)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    rows, lettered, marginals = label_words(model, texts)
    n = len(texts)
    sums = np.stack([np.bincount(rows[lettered], weights=marginals[lettered, j], minlength=n) for j in range(len(model.labels))], axis=1)
    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    names = [model.labels[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
    return names, np.where(total > 0, np.round(sums.max(axis=1) / np.maximum(total, 1e-30), 9), 0.0)


def fair_share(counts: list[int], total: int) -> int:
    """The greatest k with sum(min(n, k)) <= total, 1 at least."""
    left, ordered = total, sorted(counts)
    for i, n in enumerate(ordered):
        if n * (len(ordered) - i) > left:
            return max(1, left // (len(ordered) - i))
        left -= n
    return max(1, *ordered)


def training_rows(known: DataFrame, total: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """(text, lang) of the training sample of ``known``: of each language the rows with the least hashes."""
    hashed = known.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = dict(hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect())
    if not counts:
        return []
    k = fair_share(list(counts.values()), total)
    # tasks send rows under a cut of the hash, somewhat more than k; the counts are off by a few per cent
    wanted = 1.2 * k + 8 * math.sqrt(k) + 16
    cuts = [(lang, (1 << 63) - 1 if n <= wanted else int((1 << 64) * (wanted / n)) - (1 << 63)) for lang, n in counts.items()]
    cut = F.broadcast(known.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    some = hashed.join(cut, "lang").filter("h <= cut").select("lang", "h", "text").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sent = some.withColumn("place", place).filter(F.col("place") <= math.ceil(1.1 * k) + 16).select("text", "lang", "place").collect()
    # the true k, now that the counts of languages with few rows are exact
    k = fair_share(list(Counter(r.lang for r in sent).values()), total)
    return sorted((r.text, r.lang) for r in sent if r.place <= k)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of each row, learned from rows that are not ``held_out`` (a column over doc_id) and have a language."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = named.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(training_rows(known))
    if not model.labels:
        return named.select("doc_id", held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(batches):
        for batch in sliced(batches, "text", 2 << 20):
            names, scores = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return named.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(label, OUT_SCHEMA)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; every fourth by the hash of its id is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, held)
