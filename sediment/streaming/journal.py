"""A journal kept by micro-batches: each batch upserts the latest state of its keys.

The state is cut into buckets by a hash of the key. A batch writes the buckets that it touches under its own
number, from those of the batches before it, and it counts once its folder is complete; the present state is the newest complete
version of every bucket. Which batches there are is read from the sink and nothing is kept in the driver, so
a query that is started again on the same folder goes on where it stopped, and a batch that is run again after a
failure replaces its own folder (exactly once).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators.snapshots import latest
from sediment.storage import file_system, scratch_path

BUCKETS = 16


def complete_batches(spark: SparkSession, folder: str) -> dict[int, set[int]]:
    """Buckets of each batch whose folder is complete."""
    store, target = file_system(spark, folder)
    out = {}
    if not store.exists(target):
        return out
    for entry in store.listStatus(target):
        found = re.fullmatch(r"batch-(\d+)", entry.getPath().getName())
        if found:
            inside = [e.getPath().getName() for e in store.listStatus(entry.getPath())]
            if "_SUCCESS" in inside:
                out[int(found[1])] = {int(n.removeprefix("bucket=")) for n in inside if n.startswith("bucket=")}
    return out


def state(spark: SparkSession, folder: str, schema, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The newest complete version of each bucket (of ``buckets``), of batches ``before`` a number."""
    newest: dict[int, int] = {}
    for number, there in sorted(complete_batches(spark, folder).items()):
        if before is None or number < before:
            newest |= {b: number for b in there if buckets is None or b in buckets}
    if not newest:
        return spark.createDataFrame([], schema)
    by_batch: dict[int, list[int]] = {}
    for bucket, number in newest.items():
        by_batch.setdefault(number, []).append(bucket)
    parts = [spark.read.schema(schema).parquet(*(f"{folder}/batch-{n}/bucket={b}" for b in sorted(own))) for n, own in by_batch.items()]
    return reduce(DataFrame.unionByName, parts)


def run_to_end(spark: SparkSession, path: str, keys: tuple[str, ...] = ("user_id",), order: tuple[str, ...] = ("ts", "event_id"), files_per_batch: int = 4, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Consume all files at ``path`` that are new to ``folder`` as a stream; returns the state after them."""
    folder = folder or scratch_path(spark, "journal")
    schema = spark.read.parquet(path).schema

    def upsert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        rows = batch.select(*schema.names)
        touched = {r.bucket for r in rows.select(own).distinct().collect()}  # as many as there are buckets, at most
        if touched:
            both = rows.unionByName(state(session, folder, schema, number, touched))
            latest(both, list(keys), list(order)).select("*", own).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch-{number}")

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    store, target = file_system(spark, path)
    if store.getFileStatus(target).isFile():
        head, _, name = path.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(head)
    else:
        stream = reader.parquet(path)
    work = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    work.awaitTermination()
    return state(spark, folder, schema)
