"""Listings and selections: tables viewed as catalogs of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import scalars
from sediment.operators import selection
from sediment.operators.packing import numbered
from sediment.plans.registry import registry

QUERIES, ORACLES, query = registry()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def list_totals(spark, sf_dir):
    """Files and bytes per language."""
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%rod' OR p_name LIKE 'l_rge%t'")
def list_select(spark, sf_dir):
    """Parts by name patterns with both wildcards."""
    return selection.select(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", selection.split_list("*rod,\"l%rge*t\""))


@query("SELECT page_id, url FROM pages WHERE NOT (url LIKE '%.example.com/fr/%') AND url LIKE 'http%'")
def list_exclude(spark, sf_dir):
    """Pages not excluded by a pattern, then selected."""
    return selection.select(read(spark, sf_dir, "pages").select("page_id", "url"), "url", ["http*"], ["*.example.com/fr/*"])


@query("SELECT page_id, url FROM pages WHERE page_id % 7 = 0 OR url LIKE '%/de/%'")
def list_select_walk(spark, sf_dir):
    """A walk's selection: directories (every seventh page here) pass whatever their names."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return selection.select(pages, "url", ["*/de/*"], is_dir=F.col("page_id") % 7 == 0)


@query("""
WITH e AS (SELECT p_partkey, replace(p_type, ' ', '/') || '/' || p_partkey AS path FROM part)
SELECT p_partkey, path FROM e WHERE NOT (path LIKE 'STANDARD/%' OR path = 'STANDARD')""")
def exclude_subtree(spark, sf_dir):
    """Everything below an excluded directory goes with it."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), F.col("p_partkey")).alias("path"))
    tops = parts.select(F.lit(None).cast("long").alias("p_partkey"), F.split("path", "/")[0].alias("path")).distinct()
    return selection.prune_subtrees(parts.unionByName(tops), "path", ["STANDARD"]).filter("p_partkey IS NOT NULL").select("p_partkey", "path")


@query("""
SELECT o_orderkey, printf('%s%s %4d %-10s %12d %s', CASE WHEN o_orderstatus = 'F' THEN 'd' ELSE '-' END,
  CASE (o_orderkey % 4) WHEN 0 THEN 'rw-r--r--' WHEN 1 THEN 'rwxr-xr-x' WHEN 2 THEN 'rwsr-x--T' ELSE '-wx--S---' END,
  1 + o_custkey % 9, o_orderpriority, floor(o_totalprice)::BIGINT, strftime(o_orderdate, '%Y-%m-%d')) AS line FROM orders""")
def list_ls_format(spark, sf_dir):
    """Orders as lines of a long listing."""
    mode = F.element_at(F.array(*(F.lit(m) for m in (0o644, 0o755, 0o5750, 0o2300))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    letter = F.when(F.col("o_orderstatus") == "F", "d").otherwise("-")
    line = F.format_string("%s%s %4d %-10s %12d %s", letter, scalars.permissions(mode), 1 + F.col("o_custkey") % 9, "o_orderpriority", F.floor("o_totalprice").cast("long"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("SELECT page_id, url, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS fileno FROM pages")
def list_depth_order(spark, sf_dir):
    """Pages numbered in walk order: component by component."""
    return numbered(read(spark, sf_dir, "pages").select("page_id", "url"), [*selection.path_order("url"), F.col("page_id")], "fileno", 1)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def since_before(spark, sf_dir):
    """Half-open interval of times."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return orders.filter(selection.chosen_by_time(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-07-01").cast("timestamp")))


@query("SELECT o_orderstatus, o_orderdate < TIMESTAMP '1996-01-01' AS present, count(*) AS n FROM orders GROUP BY ALL")
def since_present(spark, sf_dir):
    """What a time filter does not choose stays covered: a flag, not a filter."""
    flagged = read(spark, sf_dir, "orders").withColumn("present", ~selection.chosen_by_time(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp")))
    return flagged.groupBy("o_orderstatus", "present").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def by_owner(spark, sf_dir):
    """Entries of one owner."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").filter("o_custkey = 7")


@query("SELECT page_id, url FROM pages WHERE url = 'http:' OR starts_with(url, 'http:/')")
def named_or_below(spark, sf_dir):
    """Named entries and all below them."""
    return read(spark, sf_dir, "pages").select("page_id", "url").filter(selection.within(F.col("url"), ["http:/"]))


@query("SELECT page_id, url <> '' AND NOT starts_with(url, '/') AND NOT regexp_matches(url, '(^|/)\\.\\.(/|$)') AS safe, len(string_split(url, '/')) <= 5 AS shallow FROM pages")
def safe_names(spark, sf_dir):
    """Names that a restore accepts, and the depth limit."""
    return read(spark, sf_dir, "pages").select("page_id", selection.safe_name(F.col("url")).alias("safe"), selection.below_depth(F.col("url"), 5).alias("shallow"))


@query("SELECT doc_id, text FROM documents WHERE doc_id = 17")
def extract_point(spark, sf_dir):
    """One entry by exact key: the filter reaches the scan."""
    return read(spark, sf_dir, "documents").filter("doc_id = 17").select("doc_id", "text")


@query("""
SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS files, sum(floor(o_totalprice)::BIGINT) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS bytes,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS present FROM orders""")
def saved_totals(spark, sf_dir):
    """Totals of a listing: saved entries, bytes of regular files, and entries only present."""
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").agg(F.count_if(status != "F").alias("files"), F.sum(F.when(status == "O", F.floor("o_totalprice").cast("long"))).alias("bytes"), F.count_if(status == "F").alias("present"))


@query("""
SELECT user_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS exit_code FROM events GROUP BY user_id""")
def severity_exit(spark, sf_dir):
    """Exit code of each user: the largest severity of its messages."""
    severity = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(severity).alias("exit_code"))
