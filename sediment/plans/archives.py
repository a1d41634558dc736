"""Archives written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.operators import snapshots
from sediment.plans.catalog import read
from sediment.plans.registry import registry
from sediment.sources import blocks, codecs, crypto, journal, saveset, vms
from sediment.storage import scratch_path

QUERIES, ORACLES, query = registry()
#: Documents of one saveset, about.
DOCUMENTS_A_SET = 2000


def folder(spark) -> str:
    return scratch_path(spark, "savesets")


def sets_of(docs) -> int:
    return max(8, docs.count() // DOCUMENTS_A_SET)


def saved(spark, sf_dir, layout: blocks.Layout) -> str:
    """Documents as files of savesets; returns their folder."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(sets_of(docs))).alias("part"), F.concat_ws("/", "lang", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    where = folder(spark)
    saveset.write(files, where, "part", layout).write.parquet(f"{where}-written")
    return where


IDENTITY = "SELECT lang || '/' || doc_id AS path, strlen(text)::BIGINT AS size, sha256(text) AS digest, true AS intact FROM documents"


def delivered(spark, where: str):
    return saveset.read(spark, where).select("path", "size", F.sha2("content", 256).alias("digest"), "intact")


@query(IDENTITY)
def saveset_roundtrip(spark, sf_dir):
    """Documents through compressed savesets with parity and back."""
    return delivered(spark, saved(spark, sf_dir, blocks.Layout(block=16384, group=5, codec=codecs.DEFLATE)))


@query(IDENTITY)
def saveset_solid(spark, sf_dir):
    """The same with small files compressed together, in volumes."""
    return delivered(spark, saved(spark, sf_dir, blocks.Layout(block=8192, group=4, volume=8192 * 16, codec=codecs.LZMA, solid=True)))


@query(IDENTITY)
def encrypt_roundtrip(spark, sf_dir):
    """Documents through encrypted savesets."""
    keys = crypto.Keys.derive(b"a few random words", rounds=2000)
    where = saved(spark, sf_dir, blocks.Layout(block=16384, group=5, codec=codecs.DEFLATE, keys=keys))
    return saveset.read(spark, where, passphrase="a few random words").select("path", "size", F.sha2("content", 256).alias("digest"), "intact")


@query("SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || CASE WHEN text = '' OR right(text, 1) IN (chr(10), chr(13)) THEN '' ELSE chr(10) END) AS digest FROM documents")
def vms_records_to_text(spark, sf_dir):
    """Documents as variable-length records of foreign savesets and back to text."""
    found = vms.read(spark, foreign(spark, sf_dir)).select(F.regexp_extract("path", r"D(\d+)\.TXT$", 1).cast("long").alias("doc_id"), "text")
    return found.select("doc_id", F.sha2("text", 256).alias("digest"))


def foreign(spark, sf_dir) -> str:
    """Documents as files of foreign savesets; returns their folder."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(sets_of(docs))).alias("part"), F.format_string("[DOCS]D%d.TXT;1", "doc_id").alias("spec"), vms.variable_text(F.col("text")).alias("content"), F.lit(vms.VARIABLE).alias("format"), F.lit(vms.CARRIAGE_RETURN).alias("attributes"))
    where = folder(spark)
    vms.write_sets(rows, where).write.format("noop").mode("overwrite").save()
    return where


@query("SELECT count(*) AS files, count(*) FILTER (WHERE doc_id = 17) AS wanted, 0::BIGINT AS damaged FROM documents")
def vms_totals(spark, sf_dir):
    """Files of foreign savesets, those wanted by name, and damaged ones."""
    return vms.read(spark, foreign(spark, sf_dir)).agg(F.count(F.lit(1)).alias("files"), F.count_if(vms.named("[docs]d17.txt;1")).alias("wanted"), F.count_if("damaged").alias("damaged"))


@query(IDENTITY)
def stream_split(spark, sf_dir):
    """Savesets as forward-only streams, split back into volumes and delivered."""
    where = saved(spark, sf_dir, blocks.Layout(block=8192, group=4, volume=8192 * 16))
    saveset.as_streams(spark, where, f"{where}-streams").write.format("noop").mode("overwrite").save()
    saveset.split_streams(spark, f"{where}-streams", f"{where}-again").write.format("noop").mode("overwrite").save()
    return delivered(spark, f"{where}-again")


def damaged(spark, where: str, layout: blocks.Layout, lost: int) -> str:
    """A copy of the savesets in which ``lost`` blocks of each full group are overwritten."""
    span = layout.group + layout.parity

    def change(place: int, count: int, block: bytes) -> bytes:
        group, i = divmod(place - 1, span)
        return b"\xff" * len(block) if 0 <= group < (count - 2) // span and i % 2 == 0 and i < 2 * lost else block

    target = f"{where}-damaged"
    saveset.transfer(spark, where, target, change).write.format("noop").mode("overwrite").save()
    return target


@query(IDENTITY)
def saveset_repair(spark, sf_dir):
    """Two lost blocks in every full group, repaired by two parity rows."""
    layout = blocks.Layout(block=8192, group=5, parity=2)
    return delivered(spark, damaged(spark, saved(spark, sf_dir, layout), layout, 2))


@query()
def saveset_loss(spark, sf_dir):
    """More lost blocks than parity: every catalogued file is delivered intact, named damaged or named lost."""
    layout = blocks.Layout(block=8192, group=5, parity=1)
    where = damaged(spark, saved(spark, sf_dir, layout), layout, 2)
    got = saveset.read(spark, where).select("saveset", "fileno", "intact")
    listed = saveset.read(spark, where, "catalog").select("saveset", "fileno")
    verdict = F.when(F.col("intact"), "intact").when(~F.col("intact"), "damaged").otherwise("lost")
    return listed.join(got, ["saveset", "fileno"], "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT 'catalog' AS kind, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents")
def catalog_scan(spark, sf_dir):
    """Entries and bytes from the catalogs alone."""
    where = saved(spark, sf_dir, blocks.Layout(block=16384, codec=codecs.DEFLATE))
    entries = saveset.read(spark, where, "catalog")
    return entries.select(F.lit("catalog").alias("kind"), "size").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("SELECT t AS type, count(*) AS n FROM (SELECT unnest([2, 4]) AS t FROM documents) GROUP BY t")
def records_scan(spark, sf_dir):
    """FILE and FEND records by type."""
    where = saved(spark, sf_dir, blocks.Layout(block=8192, group=3))
    return saveset.read(spark, where, "records").filter("type IN (2, 4)").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(IDENTITY)
def transfer_copy(spark, sf_dir):
    """Savesets copied block for block, with blocks damaged on the way, delivered from the copy."""
    layout = blocks.Layout(block=8192, group=4, parity=2, codec=codecs.DEFLATE)
    return delivered(spark, damaged(spark, saved(spark, sf_dir, layout), layout, 1))


@query("SELECT 'copied' AS kind, 0::BIGINT AS bad, true AS same")
def transfer_totals(spark, sf_dir):
    """Totals of a transfer: as many blocks as the source has, none of them bad."""
    where = saved(spark, sf_dir, blocks.Layout(block=8192, group=3))
    totals = saveset.transfer(spark, where, f"{where}-copy").agg(F.sum("blocks").alias("blocks"), F.sum("bad").alias("bad"))
    scanned = saveset.read(spark, where, "blocks").agg(F.count(F.lit(1)).alias("scanned"))
    return totals.crossJoin(scanned).select(F.lit("copied").alias("kind"), "bad", (F.col("blocks") == F.col("scanned")).alias("same"))  # one row each


@query("SELECT lang || '/' || doc_id AS path, strlen(text)::BIGINT AS size, sha256(text) AS digest FROM documents WHERE doc_id = 17")
def extract_by_name(spark, sf_dir):
    """One file by exact name: trailer, catalog and the file's own records are all that is read."""
    lang = read(spark, sf_dir, "documents").filter("doc_id = 17").select("lang").first()
    where = saved(spark, sf_dir, blocks.Layout(block=8192, group=5, codec=codecs.LZMA, solid=True))
    name = f"{lang[0] if lang else ''}/17"
    return saveset.read(spark, where).filter(F.col("path") == name).select("path", "size", F.sha2("content", 256).alias("digest"))


@query("""
SELECT lang || '/' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 9 = 1 THEN 'type'
  WHEN doc_id % 9 = 2 THEN 'size' WHEN doc_id % 9 = 3 THEN CASE WHEN text = '' THEN 'size' WHEN strlen(substr(text, length(text) // 2 + 1, 1)) > 1 THEN 'shorter' ELSE 'octet ' || strlen(left(text, length(text) // 2)) END
  WHEN doc_id % 9 = 4 AND text <> '' THEN 'shorter' ELSE 'same' END AS difference FROM documents""")
def compare_content(spark, sf_dir):
    """Savesets compared with a tree that was changed after the save, octet by octet."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "doc_id").alias("path"), "text")
    case, half = F.col("doc_id") % 9, F.floor(F.length("text") / 2).cast("int")
    # 3: U+0001 for the character at half of the text; for a wider one the record is no longer all there
    edited = F.concat(F.expr("left(text, length(text) div 2)"), F.lit("\x01"), F.substring("text", half + 2, F.length("text")))
    now = F.when(case == 2, F.concat("text", F.lit("more"))).when(case == 3, edited).when(case == 4, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    found = docs.filter(case != 0).select("path", F.when(case == 1, blocks.DIRECTORY).otherwise(blocks.REGULAR).alias("ftype"), F.lit(None).cast("string").alias("link"), now.cast("binary").alias("content"))
    where = saved(spark, sf_dir, blocks.Layout(block=16384, codec=codecs.DEFLATE))
    return snapshots.compare_entries(saveset.read(spark, where), found).select("path", "difference")


def chain_of_saves(spark, sf_dir) -> list[str]:
    """A full save, and an incremental one: a quarter is new, one changed, one gone, the last only present."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("/", "lang", "doc_id").alias("path"), "text")
    case, part, where = F.col("doc_id") % 4, F.pmod(F.xxhash64("doc_id"), F.lit(sets_of(docs))).alias("part"), folder(spark)
    plain = [F.lit(blocks.REGULAR).alias("ftype"), F.lit(None).cast("binary").alias("content"), F.lit(blocks.OK).alias("status"), F.lit(0).cast("long").alias("size")]
    content = F.col("text").cast("binary")
    layout = blocks.Layout(block=16384, codec=codecs.DEFLATE)
    first = docs.filter(case != 3).select(part, "path", plain[0], content.alias("content"), plain[2], plain[3])
    saveset.write(first, f"{where}/0", "part", layout, kind=blocks.FULL).write.parquet(f"{where}-0")
    dirs = docs.select("lang").distinct().select(F.lit(0).cast("long").alias("part"), F.col("lang").alias("path"), F.lit(blocks.DIRECTORY).alias("ftype"), *plain[1:])
    changed = F.when(case == 2, F.concat("text", F.lit("v2")).cast("binary")).when(case == 3, content)
    second = docs.filter(case != 1).select(part, "path", plain[0], changed.alias("content"), F.when(case == 0, blocks.PRESENT).otherwise(blocks.OK).alias("status"), F.octet_length("text").cast("long").alias("size"))
    saveset.write(second.unionByName(dirs), f"{where}/1", "part", layout, kind=blocks.INCREMENTAL).write.parquet(f"{where}-1")
    return [f"{where}/0", f"{where}/1"]


@query("SELECT lang || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 4 = 2 THEN text || 'v2' ELSE text END) AS digest FROM documents WHERE doc_id % 4 <> 1")
def restore_chain(spark, sf_dir):
    """The files after a full and an incremental saveset, removed ones gone."""
    return saveset.restore_chain(spark, chain_of_saves(spark, sf_dir)).filter(F.col("ftype") == blocks.REGULAR).select("path", F.sha2("content", 256).alias("digest"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 0 END::INT AS status FROM documents WHERE doc_id % 4 <> 1) GROUP BY status")
def catalog_states(spark, sf_dir):
    """Saved and only present files of an incremental catalog."""
    entries = saveset.read(spark, chain_of_saves(spark, sf_dir)[1], "catalog").filter(F.col("ftype") == blocks.REGULAR)
    return entries.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def recorded_saves(spark, sf_dir) -> str:
    """Two saves of pages below absolute bases, the second of every third page, changed, and made later."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    where = folder(spark)
    for k, rows in enumerate((pages, pages.filter("page_id % 3 = 0"))):
        files = rows.select(F.concat(F.lit(f"{k}-"), F.pmod(F.xxhash64("page_id"), F.lit(8))).alias("part"), F.concat(F.lit("p/"), F.col("page_id")).alias("path"), "content", (F.lit(1000 * (k + 1)) + F.col("page_id")).alias("ctime_sec"), F.lit(5).cast("long").alias("dev"), F.col("page_id").alias("ino"))
        saveset.write(files, where, "part", blocks.Layout(block=16384), created=(100 + k, 0), base=[b"/srv"]).write.parquet(f"{where}-{k}")
    return where


@query("SELECT '/srv/p/' || page_id AS path, page_id AS ino, CASE WHEN page_id % 3 = 0 THEN 2000 ELSE 1000 END + page_id AS ctime_sec, strlen(coalesce(html, ''))::BIGINT AS size, CASE WHEN page_id % 3 = 0 THEN 101 ELSE 100 END::BIGINT AS recorded_sec FROM pages")
def journal_rebuild(spark, sf_dir):
    """The journal made anew from the catalogs of all savesets, written as a file and read back."""
    where = recorded_saves(spark, sf_dir)
    path = f"{where}-journal"
    journal.commit(*journal.rebuilt(spark, where), path)
    return journal.read(spark, path).select("path", "ino", "ctime_sec", "size", "recorded_sec")


@query("SELECT created_sec, sum(n)::BIGINT AS nfiles FROM (SELECT 100::BIGINT AS created_sec, count(*) AS n FROM pages UNION ALL SELECT 101, count(*) FROM pages WHERE page_id % 3 = 0) GROUP BY created_sec")
def journal_savesets(spark, sf_dir):
    """Files of the savesets that a rebuilt journal file names, by the time they were made."""
    where = recorded_saves(spark, sf_dir)
    path = f"{where}-journal"
    journal.commit(*journal.rebuilt(spark, where), path)
    return journal.read(spark, path, "savesets").groupBy("created_sec").agg(F.sum("nfiles").alias("nfiles"))


@query("SELECT 'sediment' AS product, true AS whole, sum(1)::BIGINT AS nfiles, sum(strlen(text))::BIGINT AS nbytes FROM documents")
def summary_scan(spark, sf_dir):
    """Totals that the trailers tell, a few blocks of each saveset being read."""
    where = saved(spark, sf_dir, blocks.Layout(block=8192, group=5, volume=8192 * 64))
    return saveset.read(spark, where, "summary").groupBy("product", "whole").agg(F.sum("nfiles").alias("nfiles"), F.sum("nbytes").alias("nbytes"))


@query(IDENTITY)
def saveset_lz4(spark, sf_dir):
    """Documents through savesets of the fast codec."""
    return delivered(spark, saved(spark, sf_dir, blocks.Layout(block=16384, group=5, codec=codecs.LZ4)))
