"""Names, specifications and listings over keys of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import listing, names
from sediment.operators import selection
from sediment.plans.archives import saved
from sediment.plans.catalog import read
from sediment.plans.registry import registry
from sediment.sources import blocks, saveset

QUERIES, ORACLES, query = registry()


@query(r"""
WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || '.bck' WHEN 1 THEN p_name || '.SAV' WHEN 2 THEN '-' WHEN 3 THEN '.bck' WHEN 4 THEN 'a/.../' || p_name ELSE p_name || '*' END AS spec FROM part)
SELECT p_partkey, p_partkey % 6 < 3 AS is_set, p_partkey % 6 >= 4 AS wild FROM s""")
def saveset_names(spark, sf_dir):
    """Which specifications name savesets, and which files that a walk finds."""
    case, name = F.col("p_partkey") % 6, F.col("p_name")
    spec = F.when(case == 0, F.concat(name, F.lit(".bck"))).when(case == 1, F.concat(name, F.lit(".SAV"))).when(case == 2, "-").when(case == 3, ".bck").when(case == 4, F.concat(F.lit("a/.../"), name)).otherwise(F.concat(name, F.lit("*")))
    return read(spark, sf_dir, "part").select("p_partkey", names.is_saveset_name(spec).alias("is_set"), names.has_wildcard(spec).alias("wild"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 2 THEN n_name END AS node, CASE n_nationkey % 4 WHEN 0 THEN '/srv/a::b' WHEN 1 THEN ':x' END AS file FROM nation""")
def node_specs(spark, sf_dir):
    """Node and file of remote specifications; a path before the colons or nothing after them is no node."""
    case, name = F.col("n_nationkey") % 4, F.col("n_name")
    spec = F.when(case == 0, F.concat(name, F.lit("::/srv/a::b"))).when(case == 1, F.concat(name, F.lit(":::x"))).when(case == 2, F.concat(F.lit("a/"), name, F.lit("::f"))).otherwise(F.concat(name, F.lit("::")))
    node, file = names.node_and_file(spec)
    return read(spark, sf_dir, "nation").select("n_nationkey", node.alias("node"), file.alias("file"))


@query("SELECT c_custkey, upper(c_name) AS name, lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, ' ') AS number FROM customer")
def columns_of_text(spark, sf_dir):
    """ASCII upper case, and numbers in columns that grow with them."""
    return read(spark, sf_dir, "customer").select("c_custkey", names.upper_ascii(F.col("c_name")).alias("name"), names.number_column(3, F.col("c_custkey")).alias("number"))


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'CON' WHEN 1 THEN 'lpt3.txt' WHEN 2 THEN 'a//b' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'end.' WHEN 5 THEN 'what?' ELSE 'dir/' || p_name END AS name,
  p_partkey % 8 NOT IN (2, 3) AS stored_ok, p_partkey % 8 IN (2, 6, 7) AS windows_ok FROM part""")
def valid_names(spark, sf_dir):
    """Names that a reader takes, and names that Windows can have."""
    case = F.col("p_partkey") % 8
    name = F.when(case == 0, "CON").when(case == 1, "lpt3.txt").when(case == 2, "a//b").when(case == 3, "a/../b").when(case == 4, "end.").when(case == 5, "what?").otherwise(F.concat(F.lit("dir/"), "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), names.stored_name_ok(name).alias("stored_ok"), names.windows_name_ok(name).alias("windows_ok"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '/srv/data' WHEN 1 THEN '.' WHEN 2 THEN '/' WHEN 3 THEN '/srv/..' WHEN 4 THEN '/srv' WHEN 5 THEN '/' ELSE 'a/b' END AS base,
  CASE WHEN p_partkey % 7 IN (0, 1, 6) THEN 'wildcard' WHEN p_partkey % 7 = 3 THEN 'self' ELSE 'plain' END AS kind FROM part""")
def base_split(spark, sf_dir):
    """The invariant part of specifications, and what kind they are."""
    case, name = F.col("p_partkey") % 7, F.translate("p_name", " ", "_")
    spec = F.when(case == 0, F.concat(F.lit("/srv/data/x*/"), name)).when(case == 1, F.concat(F.lit("...//"), name)).when(case == 2, F.concat(F.lit("/"), name)).when(case == 3, "/srv/..//").when(case == 4, F.concat(F.lit("/srv/"), name, F.lit("///"))).when(case == 5, F.concat(F.lit("/"), name, F.lit("/"))).otherwise(F.concat(F.lit("a/b/%/"), name))
    base, kind = names.base_and_kind(spec)
    return read(spark, sf_dir, "part").select("p_partkey", base.alias("base"), kind.alias("kind"))


@query("""
SELECT p_partkey, 'System:' || CASE WHEN p_partkey & 1 = 0 THEN 'R' ELSE '' END || CASE WHEN p_partkey & 2 = 0 THEN 'W' ELSE '' END || CASE WHEN p_partkey & 4 = 0 THEN 'E' ELSE '' END || CASE WHEN p_partkey & 8 = 0 THEN 'D' ELSE '' END
  || ', Owner:' || CASE WHEN p_partkey & 16 = 0 THEN 'R' ELSE '' END || CASE WHEN p_partkey & 32 = 0 THEN 'W' ELSE '' END || CASE WHEN p_partkey & 64 = 0 THEN 'E' ELSE '' END || CASE WHEN p_partkey & 128 = 0 THEN 'D' ELSE '' END
  || ', Group:' || CASE WHEN p_partkey & 256 = 0 THEN 'R' ELSE '' END || CASE WHEN p_partkey & 512 = 0 THEN 'W' ELSE '' END || CASE WHEN p_partkey & 1024 = 0 THEN 'E' ELSE '' END || CASE WHEN p_partkey & 2048 = 0 THEN 'D' ELSE '' END
  || ', World:RWED' AS protection, printf('[%06o,%06o]', p_partkey % 65536, 8) AS uic FROM part WHERE p_partkey < 4096""")
def vms_owner(spark, sf_dir):
    """Protections and owners as text."""
    part = read(spark, sf_dir, "part").filter("p_partkey < 4096")
    return part.select("p_partkey", names.protection_text(F.col("p_partkey")).alias("protection"), names.uic_text(F.shiftleft(F.pmod("p_partkey", F.lit(65536)), 16) + 8).alias("uic"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderdate - INTERVAL 30 DAY >= TIMESTAMP '1997-01-01'")
def since_created(spark, sf_dir):
    """A selection by the time of creation; entries without one are not chosen."""
    created = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") - F.expr("INTERVAL 30 DAY"))
    time = selection.time_of("created", F.col("o_orderdate"), created, F.col("o_orderdate"))
    return read(spark, sf_dir, "orders").filter(selection.chosen_by_time(time, F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey")


@query("SELECT p_partkey, p_type || '/' || p_partkey AS path FROM part WHERE p_type <> 'PROMO' AND p_partkey % 10 <> 3")
def nodump(spark, sf_dir):
    """Flagged directories go with what they hold, flagged files alone."""
    files = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_partkey").alias("path"), F.lit(False).alias("dir"), (F.col("p_partkey") % 10 == 3).alias("flag"))
    dirs = read(spark, sf_dir, "part").select(F.lit(None).cast("long").alias("p_partkey"), F.col("p_type").alias("path"), F.lit(True).alias("dir"), (F.col("p_type") == "PROMO").alias("flag")).distinct()
    return selection.without_nodump(files.unionByName(dirs), "path", F.col("flag"), F.col("dir")).filter("NOT dir").select("p_partkey", "path")


@query("""
SELECT lang || '/' || doc_id AS path, rpad(lang || '/' || doc_id, greatest(46, length(lang || '/' || doc_id))::INT, ' ') || '  ' || lpad(strlen(text)::VARCHAR, greatest(12, length(strlen(text)::VARCHAR))::INT, ' ') || '   1-JAN-1970 00:00' AS line FROM documents""")
def list_brief(spark, sf_dir):
    """The short listing of savesets, from their catalogs."""
    entries = saveset.read(spark, saved(spark, sf_dir, blocks.Layout(block=16384)), "catalog")
    return entries.select("path", listing.brief_line(F.col("path"), F.col("ftype"), F.col("size"), F.timestamp_seconds("mtime_sec")).alias("line"))


@query("""
SELECT o_orderkey, 'f' || o_orderkey || chr(10) || '    Type: ' || rpad(t, greatest(12, length(t))::INT, ' ') || '  Size: ' || rpad(s, greatest(14, length(s))::INT, ' ') || '  Owner: ?:g (' || o_custkey || ',7)  Protection: ' || l || 'rw-r--r--'
  || chr(10) || '    Modified: ' || lpad(upper(strftime(o_orderdate, '%-d-%b-%Y %H:%M:%S.00')), 23, ' ') || '  Checksum: ' || upper(lpad(printf('%x', o_orderkey), 8, '0')) || '  Status: ' || CASE o_orderkey % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'changed while saved' ELSE 'read error' END
  || CASE WHEN o_orderkey % 9 = 3 THEN chr(10) || '    Link to: x' ELSE '' END AS lines
FROM (SELECT *, floor(o_totalprice)::BIGINT::VARCHAR AS s, ['?', 'file', 'directory', 'symlink', 'hard link', 'character device', 'block device', 'FIFO', 'socket'][o_orderkey % 9 + 1] AS t, '?-dl-cbps'[o_orderkey % 9 + 1] AS l FROM orders)""")
def list_full(spark, sf_dir):
    """The full listing: three lines an entry, four for a link."""
    o, kind = read(spark, sf_dir, "orders"), (F.col("o_orderkey") % 9).cast("int")
    lines = listing.full_lines(F.concat(F.lit("f"), "o_orderkey"), kind, F.floor("o_totalprice").cast("long"), F.lit(None).cast("string"), F.lit("g"), F.col("o_custkey"), F.lit(7), F.lit(0o644), F.col("o_orderdate"), F.col("o_orderkey"), (F.col("o_orderkey") % 3).cast("int"), F.when(kind == 3, "x"))
    return o.select("o_orderkey", lines.alias("lines"))


@query("""
SELECT o_orderkey, '?-dl-cbps'[o_orderkey % 9 + 1] || 'rwxr-x--- ' || lpad((1 + o_custkey % 3)::VARCHAR, 3, ' ') || ' ' || rpad('u', 8, ' ') || '  ' || rpad('?', 8, ' ') || '  ' || lpad(floor(o_totalprice)::BIGINT::VARCHAR, 10, ' ') || ' ' || strftime(o_orderdate, '%m-%d-%Y %H:%M:%S') || ' f' || o_orderkey
  || CASE WHEN o_orderkey % 9 IN (3, 4) THEN ' -> x' ELSE '' END AS line FROM orders""")
def list_long(spark, sf_dir):
    """The listing that file managers read."""
    kind = (F.col("o_orderkey") % 9).cast("int")
    line = listing.long_line(F.concat(F.lit("f"), "o_orderkey"), kind, F.lit(0o750), 1 + F.col("o_custkey") % 3, F.lit("u"), F.lit(None).cast("string"), F.floor("o_totalprice").cast("long"), F.col("o_orderdate"), F.when(kind.isin(3, 4), "x"))
    return read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
