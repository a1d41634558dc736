"""Comparisons, journals, chains and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators import snapshots
from sediment.plans.catalog import read
from sediment.plans.registry import registry

QUERIES, ORACLES, query = registry()


def altered(orders: DataFrame) -> DataFrame:
    """Orders as found later: some gone, some owners, prices and states changed."""
    key = F.col("o_orderkey")
    found = orders.filter(key % 11 != 0)
    return found.withColumns({
        "o_custkey": F.when(key % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")),
        "o_totalprice": F.when(key % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(key % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")),
    })


@query("""
SELECT doc_id, CASE WHEN doc_id <> first THEN first END AS link FROM
(SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents)""")
def hardlink_first_name(spark, sf_dir):
    """Documents of equal content: the first keeps it, others link to it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    return snapshots.first_names(docs, ["content"], "doc_id", "doc_id").select("doc_id", "link")


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def journal_latest(spark, sf_dir):
    """Latest record of each user."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return snapshots.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""
SELECT user_id, min(event_id) AS seq, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def saveset_upsert(spark, sf_dir):
    """A later record replaces the earlier one but keeps its place."""
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    return snapshots.upsert_keeping_place(events, "user_id", "seq")


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 3""")
def journal_changed(spark, sf_dir):
    """Orders missing from a journal or recorded in another state."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    journal = orders.filter("o_orderkey % 9 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 3, "?").otherwise(F.col("o_orderstatus")))
    return snapshots.changed_since(orders, journal, "o_orderkey", ["o_orderstatus"])


@query("""
SELECT coalesce(p_brand, '?') AS spec, count(*) AS files FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON l_partkey = p_partkey GROUP BY ALL""")
def journal_list_left(spark, sf_dir):
    """Recorded files by their saveset, ``?`` where it is unknown."""
    parts = read(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select("p_partkey", "p_brand")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy(F.coalesce("p_brand", F.lit("?")).alias("spec")).agg(F.count(F.lit(1)).alias("files"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN 'o_custkey' WHEN o_orderkey % 5 = 0 THEN 'o_totalprice'
  WHEN o_orderkey % 17 = 0 THEN 'o_orderstatus' ELSE 'same' END AS difference FROM orders""")
def compare_left(spark, sf_dir):
    """One report for each saved order: the first difference to what is found."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return snapshots.first_difference(orders, altered(orders), ["o_orderkey"], ["o_custkey", "o_totalprice", "o_orderstatus"])


@query("""
SELECT count(*) AS files, count(*) FILTER (WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 17 = 0) AS differences FROM orders""")
def compare_totals(spark, sf_dir):
    """Totals of a comparison."""
    reports = compare_left(spark, sf_dir)
    return reports.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("difference") != "same").alias("differences"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def loss_anti(spark, sf_dir):
    """Catalogued documents that nothing was delivered for."""
    return snapshots.lost(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""
SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) AND n_nationkey % 4 = 1""")
def prune_children(spark, sf_dir):
    """Nations of known regions whose names a catalog lacks."""
    nations = read(spark, sf_dir, "nation")
    regions = read(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"))
    names = nations.filter("n_nationkey % 4 <> 1").select("n_name")
    return snapshots.prune_children(nations, regions, names, "n_regionkey", "n_name").select("n_nationkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)")
def missing_present(spark, sf_dir):
    """Present entries that are not there: customers without any of the orders looked at."""
    orders = read(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return snapshots.lost(read(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT n_name, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def base_lookup(spark, sf_dir):
    """Names with the base that their index refers to."""
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", F.concat_ws("/", "r_name", "n_name").alias("path"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")
def delete_candidates(spark, sf_dir):
    """Saved orders still found in the saved state; nothing is deleted."""
    saved = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = altered(read(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey")
    return snapshots.delete_candidates(saved, found, "o_orderkey", ["o_custkey"]).select("o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'third' WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS version FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 = 0)""")
def chain_restore(spark, sf_dir):
    """State after three savesets: the last that has an order wins, its deletions apply."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    links = [
        orders.select("o_orderkey", F.lit("first").alias("version"), F.lit(False).alias("deleted")),
        orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("second").alias("version"), F.lit(False).alias("deleted")),
        orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("third").alias("version"), (F.col("o_orderkey") % 5 == 0).alias("deleted")),
    ]
    return snapshots.chain_restore(links, "o_orderkey", "deleted")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def covered_saved(spark, sf_dir):
    """Covered entries that were not saved."""
    orders = read(spark, sf_dir, "orders")
    return snapshots.covered_not_saved(orders.select("o_orderkey"), orders.filter("o_orderdate >= timestamp'1996-01-01'").select("o_orderkey"), "o_orderkey")


@query("SELECT n_name AS name, 0 AS baseidx FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT n_name, 2 FROM nation WHERE n_regionkey = 1")
def union_specs(spark, sf_dir):
    """Inputs one after the other, each row with the number of its input."""
    nations = read(spark, sf_dir, "nation")
    return snapshots.union_specs([nations.select(F.col("n_name").alias("name")), read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), nations.filter("n_regionkey = 1").select(F.col("n_name").alias("name"))])


@query("""
SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS owner FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey""")
def owner_names(spark, sf_dir):
    """Owners by name, by number where the name is unknown."""
    names = read(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select("n_nationkey", "n_name")
    joined = read(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("owner"))


@query("""
SELECT user_id, island, min(event_id) AS first_good, count(*) AS n FROM
(SELECT user_id, event_id, event_id % 7 = 3 AS lost, sum((event_id % 7 = 3)::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS island FROM events)
WHERE NOT lost GROUP BY ALL""")
def resync_islands(spark, sf_dir):
    """Runs of good events between lost ones, with the first good event of each."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7 == 3).alias("lost"))
    good = snapshots.islands(events, ["user_id"], "event_id", "lost")
    return good.groupBy("user_id", "island").agg(F.min("event_id").alias("first_good"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def stream_journal(spark, sf_dir):
    """Events as micro-batches upserted into a journal of latest states."""
    from sediment.streaming.journal import run_to_end

    return run_to_end(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")
