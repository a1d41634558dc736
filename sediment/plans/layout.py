"""Numbers, groups, volumes, packing and parity over tables viewed as blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.operators import packing
from sediment.plans.catalog import read
from sediment.plans.registry import registry

QUERIES, ORACLES, query = registry()
ORDER = ["o_orderkey"]


def blocks(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("price"))
    return packing.numbered(orders, ORDER)


BLOCKS_SQL = "(SELECT o_orderkey, o_custkey, floor(o_totalprice)::BIGINT AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS blkno FROM orders)"


@query(f"SELECT o_orderkey, blkno FROM {BLOCKS_SQL}")
def block_number(spark, sf_dir):
    """Block numbers through all orders."""
    return blocks(spark, sf_dir).select(*ORDER, "blkno")


@query(f"SELECT o_orderkey, blkno // 11 AS grp, (blkno % 11)::INT AS gindex FROM {BLOCKS_SQL}")
def group_index(spark, sf_dir):
    """Group and place in the group: ten data blocks and one parity block."""
    grp, gindex = packing.group_of(F.col("blkno"), 10, 1)
    return blocks(spark, sf_dir).select(*ORDER, grp.alias("grp"), gindex.alias("gindex"))


@query(f"""
SELECT blkno, coalesce(lag(o_custkey) OVER (PARTITION BY blkno // 10 ORDER BY blkno), 4294967295) AS prv_recoff,
  coalesce(lag(price) OVER (PARTITION BY blkno // 10 ORDER BY blkno), 0) AS prv_paylen FROM {BLOCKS_SQL}""")
def prev_fields(spark, sf_dir):
    """Fields of the block before in the same group, fixed values for the first."""
    rows = blocks(spark, sf_dir).select("blkno", F.floor(F.col("blkno") / 10).alias("grp"), F.col("o_custkey").alias("recoff"), F.col("price").alias("paylen"))
    return packing.previous_fields(rows, "grp", "blkno", {"recoff": 4294967295, "paylen": 0}).select("blkno", "prv_recoff", "prv_paylen")


@query(f"""
SELECT blkno, o_custkey AS re_recoff, price AS re_paylen FROM {BLOCKS_SQL}
WHERE blkno % 10 = 4 AND blkno + 1 < (SELECT count(*) FROM orders)""")
def header_rebuild(spark, sf_dir):
    """Fields of a lost block (the fifth of each group) from the block after it."""
    rows = blocks(spark, sf_dir).select("blkno", F.floor(F.col("blkno") / 10).alias("grp"), F.col("o_custkey").alias("recoff"), F.col("price").alias("paylen"))
    told = packing.rebuilt_fields(packing.previous_fields(rows, "grp", "blkno", {"recoff": 4294967295, "paylen": 0}), "grp", "blkno", ["recoff", "paylen"])
    return told.filter("blkno % 10 = 4 AND re_recoff IS NOT NULL").select("blkno", "re_recoff", "re_paylen")


#: Volumes of 256 blocks, groups of ten data blocks and two parity blocks: 255 = 21 * 12 + 3, so 211 data blocks.
VOLUME = (256, 10, 2)


@query(f"""
SELECT blkno // 211 + 1 AS volno, count(*) AS n, min(blkno) AS first_block, max(1 + blkno % 211 + blkno % 211 // 10 * 2) AS last_place FROM {BLOCKS_SQL} GROUP BY ALL""")
def volume_cut(spark, sf_dir):
    """Data blocks dealt to volumes: room is kept for the parity of the last group."""
    volno, place = packing.volume_of(F.col("blkno"), *VOLUME)
    rows = blocks(spark, sf_dir).select("blkno", volno.alias("volno"), place.alias("place"))
    return rows.groupBy("volno").agg(F.count(F.lit(1)).alias("n"), F.min("blkno").alias("first_block"), F.max("place").alias("last_place"))


@query("""
WITH RECURSIVE d AS MATERIALIZED (SELECT source, doc_id, strlen(text)::BIGINT AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p(source, r, bin, used, doc_id) AS (
  SELECT source, r, 0::BIGINT, bytes, doc_id FROM d WHERE r = 1
  UNION ALL
  SELECT d.source, d.r, CASE WHEN p.used > 0 AND p.used + d.bytes > 20000 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.used > 0 AND p.used + d.bytes > 20000 THEN d.bytes ELSE p.used + d.bytes END, d.doc_id
  FROM p JOIN d ON d.source = p.source AND d.r = p.r + 1)
SELECT source, doc_id, bin FROM p""")
def solid_packing(spark, sf_dir):
    """Documents of each source packed in order into bins of 20,000 bytes."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return packing.packed(docs, ["source"], "doc_id", "bytes", 20000).select("source", "doc_id", "bin")


@query(f"SELECT blkno // 10 AS grp, bit_xor(o_custkey) AS o_custkey, bit_xor(price) AS price FROM {BLOCKS_SQL} GROUP BY ALL")
def xor_groups(spark, sf_dir):
    """XOR block of each group of ten."""
    rows = blocks(spark, sf_dir).withColumn("grp", F.floor(F.col("blkno") / 10).cast("long"))
    return packing.xor_parity(rows, "grp", ["o_custkey", "price"])


@query(f"SELECT blkno // 10 AS grp, o_custkey AS rebuilt FROM {BLOCKS_SQL} WHERE blkno % 10 = 3")
def xor_rebuild(spark, sf_dir):
    """A lost block of each group from the parity and the others."""
    rows = blocks(spark, sf_dir).withColumn("grp", F.floor(F.col("blkno") / 10).cast("long"))
    parity = rows.groupBy("grp").agg(F.bit_xor("o_custkey").alias("all"), F.bit_xor(F.when(F.col("blkno") % 10 != 3, F.col("o_custkey"))).alias("good"), F.max("blkno").alias("last"))
    return parity.filter("last % 10 >= 3").select("grp", F.col("all").bitwiseXOR(F.coalesce("good", F.lit(0))).alias("rebuilt"))


def parity_sql() -> str:
    exp, log = packing.gf_tables()
    factors = [[int(log[packing.coefficient(j, i)]) for i in range(10)] for j in range(3)]
    return f"""
WITH t AS (SELECT {[int(x) for x in exp]} AS e, {[int(x) for x in log]} AS l, {factors} AS f),
b AS (SELECT blkno // 10 AS grp, (blkno % 10)::INT AS i, (o_custkey % 256)::INT AS x FROM {BLOCKS_SQL})
SELECT grp, j AS row, bit_xor(CASE WHEN x = 0 THEN 0 ELSE e[l[x + 1] + f[j + 1][i + 1] + 1] END) AS x FROM b, t, (SELECT unnest(range(3))::INT AS j) GROUP BY grp, j"""


@query(parity_sql())
def rs_parity(spark, sf_dir):
    """Three parity rows of each group of ten byte lanes."""
    rows = blocks(spark, sf_dir).select(F.floor(F.col("blkno") / 10).cast("long").alias("grp"), (F.col("blkno") % 10).cast("int").alias("i"), (F.col("o_custkey") % 256).cast("int").alias("x"))
    return packing.parity_rows(rows, "grp", "i", ["x"], 3, 10)


@query("""
SELECT page_id, i * 512 AS off, least(512, strlen(html) - i * 512)::BIGINT AS len FROM (SELECT page_id, html, unnest(range((strlen(html) + 511) // 512)) AS i FROM pages)""")
def sparse_chunks(spark, sf_dir):
    """Pages in pieces of 512 bytes; pieces of zeros are holes."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data")).filter(F.length("data") > 0)
    at = F.explode(F.sequence(F.lit(0), F.length("data") - 1, F.lit(512))).alias("off")
    pieces = pages.select("page_id", at, "data").withColumn("piece", F.substring("data", F.col("off") + 1, F.lit(512)))
    from sediment.functions.scalars import zero_chunk

    return pieces.filter(~zero_chunk(F.col("piece"))).select("page_id", F.col("off").cast("long").alias("off"), F.length("piece").cast("long").alias("len"))
