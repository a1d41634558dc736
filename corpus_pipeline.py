"""Corpus pipeline over ``documents``: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. SQL can't express the stages (importance resampling, exact substring
removal after it, tokens), so ORACLE_SQL is None and tests hold them against brute force.

Rows are told apart by id and text. Nulls: a null text is an empty text to every stage; it is
kept until substring removal, and tokenised to no tokens. Repeated rows are near duplicates of
each other, so one of them stays. Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import decontaminate, near_duplicates, quality, sentencepiece_scan, substrings
from sediment.llm.common import row_key, scratch_path

ORACLE_SQL = None
KEYS = ["_k1", "_k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as structs beside their keys, so that no column's name can clash."""
    return docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good ones selects."""
    scored = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keyed(docs).join(scored.filter("NOT selected").select(*KEYS), KEYS, "left_anti").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    kept = near_duplicates.near_duplicates(docs).filter("keep").select(*KEYS)
    once = kept.groupBy(*KEYS).count()
    out = keyed(docs).join(once.select(*KEYS), KEYS, "left_semi")
    if once.filter("count > 1").limit(1).count():  # rows repeated with id and text
        out = out.dropDuplicates(KEYS)
    return out.select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that start twice; documents that nothing is left of go."""
    cut = substrings.remove_repeats(docs).filter("n_removed = 0 OR n_removed < n_bytes").select(*KEYS, F.col("kept").alias("_kept")).dropDuplicates(KEYS)
    out = keyed(docs).join(cut, KEYS)
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed(docs).join(found.filter("n_hit > 0").select(*KEYS), KEYS, "left_anti").select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, with the digest of the text decoded from them."""
    return sentencepiece_scan.encode(docs).select("doc_id", "n_tokens", "tokens", "token_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("substrings", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
