"""Helpers shared by the operators: shared storage, row keys and remote files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.storage import drop_scratch, file_system, materialize, scratch_path, shared_dir

__all__ = ["drop_scratch", "file_system", "make_remote_dir", "materialize", "maybe_among", "open_remote", "partitions_for", "row_key", "scratch_path", "shared_dir", "sliced", "small_batches", "utf8"]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two non-null columns that tell rows apart by id and text; repeated rows share them."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_k1"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k2"),
    ]


def utf8(text_col: str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


#: Bytes of a batch that goes to or comes from a Python worker, unless the session says otherwise.
BATCH_BYTES = "8m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of bounded bytes for this session's Python workers; long texts make Spark's own default large on both sides."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


#: Bits of the filter of :func:`maybe_among`; the words of 64 bits that are broadcast are 2^18 at most, whatever the data.
FILTER_BITS = 24


def maybe_among(rows: DataFrame, members: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``rows`` whose keys can be among those of ``members``: all that are, and few others.

    A bit for each hash value; it saves a later join from moving rows that have no partner. Null
    keys are kept where members have them. With very many members more rows pass, none is lost.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    words = members.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 AS int))")).alias("_bits"))
    placed = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6))
    met = placed.join(F.broadcast(words), "_word")
    return met.filter("(shiftrightunsigned(_bits, cast(_place & 63 AS int)) & 1L) = 1").select(*rows.columns)


def open_remote(uri: str):
    """(pyarrow file system, path) of a URI, also on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_remote_dir(uri: str) -> None:
    store, path = open_remote(uri)
    store.create_dir(path, recursive=True)


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions of the session, as an int."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches, column: str, limit: int = 1 << 20):
    """Arrow batches cut into runs of rows with about ``limit`` bytes in ``column`` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    free_memory()


def free_memory() -> None:
    """Give back what a Python worker no longer uses; it may live on, idle, beside those of the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
