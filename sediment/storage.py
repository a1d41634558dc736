"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, the checkpoint folder set on the context.

    Only a session on one machine (master ``local``) may have neither: a temporary folder is
    made for it. On a cluster that is an error, since executors would not see such a folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sediment.scratch.dir", None)
    if not where:
        set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_on_context.get() if set_on_context.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder")
        where = "file://" + tempfile.mkdtemp(prefix="sediment-")
        spark.conf.set("sediment.scratch.dir", where)
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, target = file_system(spark, path)
    store.deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, every executor can read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        store, target = file_system(df.sparkSession, parent)
        store.delete(target, True)
