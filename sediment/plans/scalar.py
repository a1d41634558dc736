"""Scalar functions over keys of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import crc, scalars
from sediment.plans.catalog import read
from sediment.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query()
def file_crc(spark, sf_dir):
    """CRC-32 of texts from the CRCs of their pieces of 1000 octets."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("data") - 1, F.lit(0)), F.lit(1000))).alias("off")
    pieces = docs.select("doc_id", at, "data").select("doc_id", F.crc32(F.expr("substring(data, off + 1, 1000)")).alias("crc"), F.greatest(F.length("data") - F.col("off") - 1000, F.lit(0)).cast("long").alias("after"))
    return crc.combined(pieces, "doc_id", "crc", "after")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size::BIGINT * 1024 WHEN 1 THEN p_size::BIGINT * 1048576 WHEN 2 THEN p_size::BIGINT ELSE NULL END AS bytes FROM part""")
def size_literal(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("K"), F.lit("MB"), F.lit(""), F.lit("X")), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.size_literal(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2000 + 1 = 1 THEN 'x.bck' WHEN o_orderkey % 2000 + 1 < 1000 THEN 'x.bck.' || lpad((o_orderkey % 2000 + 1)::VARCHAR, 3, '0') ELSE 'x.bck.' || (o_orderkey % 2000 + 1) END AS name FROM orders""")
def volspec(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.volume_name(F.lit("x.bck"), F.col("o_orderkey") % 2000 + 1).alias("name"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey & 256 <> 0 THEN 'r' ELSE '-' END || CASE WHEN p_partkey & 128 <> 0 THEN 'w' ELSE '-' END || CASE WHEN p_partkey & 2048 <> 0 THEN CASE WHEN p_partkey & 64 <> 0 THEN 's' ELSE 'S' END WHEN p_partkey & 64 <> 0 THEN 'x' ELSE '-' END
  || CASE WHEN p_partkey & 32 <> 0 THEN 'r' ELSE '-' END || CASE WHEN p_partkey & 16 <> 0 THEN 'w' ELSE '-' END || CASE WHEN p_partkey & 1024 <> 0 THEN CASE WHEN p_partkey & 8 <> 0 THEN 's' ELSE 'S' END WHEN p_partkey & 8 <> 0 THEN 'x' ELSE '-' END
  || CASE WHEN p_partkey & 4 <> 0 THEN 'r' ELSE '-' END || CASE WHEN p_partkey & 2 <> 0 THEN 'w' ELSE '-' END || CASE WHEN p_partkey & 512 <> 0 THEN CASE WHEN p_partkey & 1 <> 0 THEN 't' ELSE 'T' END WHEN p_partkey & 1 <> 0 THEN 'x' ELSE '-' END AS perms,
  CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN 5 WHEN 5 THEN 7 WHEN 6 THEN 8 ELSE 0 END AS ftype,
  CASE WHEN p_partkey & 39 = 0 THEN '-' ELSE concat_ws(' ', CASE WHEN p_partkey & 1 <> 0 THEN 'READONLY' END, CASE WHEN p_partkey & 2 <> 0 THEN 'HIDDEN' END, CASE WHEN p_partkey & 4 <> 0 THEN 'SYSTEM' END, CASE WHEN p_partkey & 32 <> 0 THEN 'ARCHIVE' END) END AS words FROM part""")
def modes(spark, sf_dir):
    """Permission letters, type codes and attribute words."""
    kind = F.element_at(F.array(*(F.lit(k) for k in (0o100000, 0o040000, 0o120000, 0o060000, 0o020000, 0o010000, 0o140000, 0))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.permissions(F.col("p_partkey")).alias("perms"), scalars.file_type(kind).alias("ftype"), scalars.windows_words(F.col("p_partkey")).alias("words"))


@query("SELECT event_id, 1000000000 + event_id AS sec FROM events")
def vms_time(spark, sf_dir):
    """Times in 100 ns since 1858 to seconds since 1970."""
    raw = F.lit(scalars.EPOCH_1858) + (F.lit(1_000_000_000) + F.col("event_id")) * 10_000_000 + 9_999_999
    return read(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", scalars.seconds_of_1858(F.col("raw")).alias("sec"))


@query("SELECT o_orderkey, lpad(upper(strftime(o_orderdate, '%-d-%b-%Y %H:%M:%S.') || lpad((date_part('microsecond', o_orderdate)::BIGINT % 1000000 // 10000)::VARCHAR, 2, '0')), 23, ' ') AS text FROM orders")
def vms_date(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.date_text(F.col("o_orderdate")).alias("text"))


@query("""
SELECT p_partkey, (CASE WHEN p_size % 2 = 1 THEN mode | 448 ELSE mode & ~73 END)::INT AS mode FROM (SELECT p_partkey, p_size, (CASE WHEN (p_partkey >> 4) & 1 = 0 THEN 256 ELSE 0 END + CASE WHEN (p_partkey >> 4) & 2 = 0 THEN 128 ELSE 0 END + CASE WHEN (p_partkey >> 4) & 4 = 0 THEN 64 ELSE 0 END
  + CASE WHEN (p_partkey >> 8) & 1 = 0 THEN 32 ELSE 0 END + CASE WHEN (p_partkey >> 8) & 2 = 0 THEN 16 ELSE 0 END + CASE WHEN (p_partkey >> 8) & 4 = 0 THEN 8 ELSE 0 END
  + CASE WHEN (p_partkey >> 12) & 1 = 0 THEN 4 ELSE 0 END + CASE WHEN (p_partkey >> 12) & 2 = 0 THEN 2 ELSE 0 END + CASE WHEN (p_partkey >> 12) & 4 = 0 THEN 1 ELSE 0 END)::INT AS mode FROM part)""")
def vms_mode(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalars.protection_mode(F.col("p_partkey"), F.col("p_size") % 2 == 1).alias("mode"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'REG' || n_regionkey || '/SUB/' || n_name || '.TXT' WHEN 1 THEN n_name ELSE 'REG' || n_regionkey || '/' || n_name END AS path FROM nation""")
def vms_name(spark, sf_dir):
    """File specifications to paths: a plain file, a file in the top directory without type, a directory."""
    n = read(spark, sf_dir, "nation")
    spec = F.when(F.col("n_nationkey") % 3 == 0, F.format_string("[REG%d.SUB]%s.TXT;1", "n_regionkey", "n_name")).when(F.col("n_nationkey") % 3 == 1, F.format_string("[000000]%s.;12", "n_name")).otherwise(F.format_string("[REG%d]%s.DIR;1", "n_regionkey", "n_name"))
    return n.select("n_nationkey", scalars.unix_name(spec).alias("path"))
