"""Queries against their SQL at the smallest scale, sources on real folders, and helpers."""

import os
from datetime import datetime

import duckdb
import pytest

from sediment.functions import scalars
from sediment.operators import packing, selection, snapshots
from sediment.plans import ORACLES, QUERIES
from sediment.sources import fswalk, saveset

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
        assert got == want
    else:
        assert got


def test_loss_is_never_silent(spark):
    got = dict(QUERIES["saveset_loss"](spark, SF).collect())
    assert sum(got.values()) == spark.read.parquet(f"{SF}/documents.parquet").count() and got["intact"] > 0


def test_walk(spark, tmp_path):
    for path, data in {"a/x.txt": "1", "a-c/y.txt": "22", "a.b": "333", "d/e/f/g.txt": "4", "skip/h.txt": "5"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(data)
    (tmp_path / "a/link").symlink_to("x.txt")
    os.link(tmp_path / "a/x.txt", tmp_path / "d/hard")
    rows = fswalk.walk(spark, str(tmp_path), exclude="skip").orderBy(*selection.path_order("path")).collect()
    assert [r.path for r in rows] == ["a", "a/link", "a/x.txt", "a-c", "a-c/y.txt", "a.b", "d", "d/e", "d/e/f", "d/e/f/g.txt", "d/hard"]
    assert {r.path: r.link for r in rows}["a/link"] == "x.txt"
    linked = snapshots.first_names(fswalk.walk(spark, str(tmp_path)).filter("nlink > 1 AND ftype = 1"), ["dev", "ino"], "path", "path").collect()
    assert {r.path: r.link for r in linked} == {"a/x.txt": None, "d/hard": "a/x.txt"}
    assert [r.path for r in fswalk.walk(spark, str(tmp_path), pattern=".../*.txt").orderBy("path").collect()] == ["a-c/y.txt", "a/x.txt", "d/e/f/g.txt", "skip/h.txt"]


def test_first_names_keep_null_identities(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", 1), (4, None, None), (5, "y", 1)], "id long, a string, b int")
    got = snapshots.first_names(rows, ["a", "b"], "id", "id")
    assert got.columns == ["a", "b", "id", "link"]
    assert {r.id: r.link for r in got.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: 3}


def test_point_read_prunes(spark, tmp_path):
    from pyspark.sql import functions as F

    from sediment.sources.blocks import Layout

    files = spark.range(20).select((F.col("id") % 4).alias("part"), F.concat(F.lit("f"), "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    saveset.write(files, f"file://{tmp_path}/sets", "part", Layout(block=8192)).collect()
    got = saveset.read(spark, f"file://{tmp_path}/sets").filter("saveset = 'set-1.bck'")
    assert got.count() == 5 and got.rdd.getNumPartitions() == 1


def test_literals():
    now = datetime(2024, 5, 6, 7, 8, 9)
    assert scalars.parse_time("tod", now) == datetime(2024, 5, 6) and scalars.parse_time("YES", now) == datetime(2024, 5, 5)
    assert scalars.parse_time("-1-00:30", now) == datetime(2024, 5, 5, 6, 38, 9)
    assert scalars.parse_time("1-jan-2020 10:00", now) == datetime(2020, 1, 1, 10)
    with pytest.raises(ValueError):
        scalars.parse_time("to", now)
    assert selection.split_list('a*,"b,c",d') == ["a*", "b,c", "d"]
    assert packing.gf_mul(2, 128) == 0x1D


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_same_result_for_any_partitioning(spark, parts):
    rows = spark.range(100).selectExpr("id * 37 % 100 as k").repartition(parts)
    assert {r.k: r.blkno for r in packing.numbered(rows, ["k"]).collect()} == {k: k for k in range(100)}


NUMBERED = ["block_number", "group_index", "prev_fields", "header_rebuild", "volume_cut", "xor_groups", "xor_rebuild", "rs_parity", "list_depth_order"]


@pytest.mark.parametrize("shuffle, advisory", [("8", "64m"), ("200", "16k")])
def test_numbered_queries_keep_every_row_of_wide_tables(spark, shuffle, advisory):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for name in ("orders", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    conf = {"spark.sql.shuffle.partitions": shuffle, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        orders = spark.read.parquet(f"{sf}/orders.parquet")
        numbers = packing.numbered(orders, ["o_orderkey"]).selectExpr("count(*) n", "count(distinct blkno) d", "min(blkno) a", "max(blkno) b").first()
        assert tuple(numbers) == (150000, 150000, 0, 149999)
        for name in NUMBERED:
            got = QUERIES[name](spark, sf).toArrow()
            columns = ", ".join(sorted(got.column_names))
            con.register("got", got)
            rest = con.execute(f"SELECT count(*) FROM ((SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM ({ORACLES[name]})) UNION ALL (SELECT {columns} FROM ({ORACLES[name]}) EXCEPT ALL SELECT {columns} FROM got))").fetchall()[0][0]
            assert rest == 0, name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_results_are_not_empty(spark):
    for name in ("list_select", "missing_present", "extract_by_name", "journal_rebuild"):
        assert QUERIES[name](spark, SF).limit(1).count() == 1, name


def test_crc_of_pieces(spark):
    import zlib

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert dict(QUERIES["file_crc"](spark, SF).collect()) == {i: zlib.crc32(t) for i, t in texts.items()}


def test_loss_is_told_file_by_file(spark):
    """Every file of a group with more lost blocks than parity is damaged or lost, and no other."""
    from sediment.plans import archives
    from sediment.sources import blocks

    layout = blocks.Layout(block=8192, group=5, parity=1)
    where = archives.saved(spark, SF, layout)
    broken = archives.damaged(spark, where, layout, 2)
    bad = {(r.saveset, r.blkno) for r in saveset.read(spark, where, "blocks").collect() if r.pos and (r.pos - 1) % 6 in (0, 2)}
    spans, size = {}, layout.wide
    for r in saveset.read(spark, where, "records").orderBy("saveset", "seq").collect():
        order = [b for b in range(r.blk, r.blk + 400) if (b - 1) % 6 != 5]  # data blocks: five of every six after the header
        touched = order[: 1 + (r.off + 8 + r.len - 1) // size]
        if r.type == blocks.FILE:
            now = spans.setdefault((r.saveset, blocks.tlv_items(r.body)["path"].decode()), set())
        if r.type in (blocks.FILE, blocks.DATA_RECORD, blocks.FEND):
            now.update(touched)
    full = {s: (n - 2) // 6 * 6 for s, n in saveset.read(spark, where, "blocks").groupBy("saveset").count().collect()}
    whole = {k for k, b in spans.items() if not any((k[0], x) in bad and x <= full[k[0]] for x in b)}
    got = saveset.read(spark, broken).filter("intact").select("saveset", "path").collect()
    assert {(r.saveset, r.path) for r in got} == whole and len(whole) > 0


def test_content_differences(spark):
    saved = spark.createDataFrame([("a", 1, None, b"x" * 70_000 + b"y"), ("b", 1, None, b""), ("c", 3, "t", None), ("d", 3, "t", None), ("e", 1, None, b"abc"), ("f", 1, None, b"abc"), ("g", 1, None, bytes(1 << 20) + b"tail"), ("h", 1, None, bytes(1 << 20) + b"tail")], "path string, ftype int, link string, content binary")
    found = spark.createDataFrame([("a", 1, None, b"x" * 70_000 + b"z"), ("b", 1, None, b""), ("c", 3, "t", None), ("d", 3, "u", None), ("f", 1, None, b"ab"), ("g", 1, None, b"\1" + bytes(1 << 20)), ("h", 1, None, bytes(1 << 20) + b"tail and more"), ("z", 1, None, b"")], "path string, ftype int, link string, content binary")
    got = dict(snapshots.compare_entries(saved, found).collect())
    assert got == {"a": "octet 70000", "b": "same", "c": "same", "d": "link", "e": "missing", "f": "shorter", "g": "octet 0", "h": "size"}


def test_streaming_journal_goes_on_after_a_restart(spark, tmp_path):
    from sediment.streaming import journal

    def put(name, rows):
        spark.createDataFrame(rows, "user_id long, ts long, event_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    put("in", [(1, 1, 1), (2, 1, 2), (3, 9, 3)])
    folder = f"file://{tmp_path}/journal"
    first = journal.run_to_end(spark, f"{tmp_path}/in", folder=folder, buckets=4)
    assert sorted(tuple(r) for r in first.collect()) == [(1, 1, 1), (2, 1, 2), (3, 9, 3)]
    put("in", [(1, 5, 4), (3, 2, 5), (4, 1, 6)])
    second = journal.run_to_end(spark, f"{tmp_path}/in", folder=folder, buckets=4)  # knows nothing but the folder
    want = [(1, 5, 4), (2, 1, 2), (3, 9, 3), (4, 1, 6)]
    assert sorted(tuple(r) for r in second.collect()) == want
    schema = second.schema
    (tmp_path / "journal/batch-1/_SUCCESS").unlink()  # a batch that did not end doesn't count
    assert sorted(tuple(r) for r in journal.state(spark, folder, schema).collect()) == [(1, 1, 1), (2, 1, 2), (3, 9, 3)]


@pytest.mark.parametrize("size, group, parity", [(256, 10, 2), (16, 4, 1), (16, 3, 1), (12, 5, 3)])
def test_volumes_are_cut_as_the_writer_cuts_them(spark, size, group, parity):
    from sediment.sources import blocks

    layout = blocks.Layout(block=8192, group=group, parity=parity, volume=8192 * size)
    for n in (1, 7, 60, 300):
        writer = blocks.Writer(layout, b"")
        for _ in range(n):
            writer.buffer = bytearray(b"x")
            writer.close_block()
        cut = [(v, p) for v, volume in enumerate(writer.volumes, 1) for p, b in enumerate(volume) if b.type == blocks.DATA]
        volno, place = packing.volume_of(packing.F.col("id"), size, group, parity)
        if n == 300:
            assert [tuple(r) for r in spark.range(n).select(volno, place).collect()] == cut
        writer.finish()
        assert packing.volume_totals(n, size, group, parity) == (len(writer.volumes), sum(map(len, writer.volumes)))


def some_sets(spark, tmp_path, **layout):
    from pyspark.sql import functions as F

    from sediment.sources.blocks import Layout

    files = spark.range(40).select((F.col("id") % 2).alias("part"), F.concat(F.lit("f"), "id").alias("path"), F.expr("cast(repeat(cast(id as string), 3000) as binary)").alias("content"))
    where = f"file://{tmp_path}/sets"
    saveset.write(files, where, "part", Layout(block=8192, group=3, **layout)).collect()
    return where


def test_missing_added_and_truncated_volumes(spark, tmp_path):
    where = some_sets(spark, tmp_path, volume=8192 * 8)
    whole = saveset.read(spark, where).count()
    (tmp_path / "away").mkdir()
    (tmp_path / "sets/set-0.bck.002").rename(tmp_path / "away/x")
    (tmp_path / "sets/set-1.bck").rename(tmp_path / "away/other")  # another saveset's volume is never taken
    less = saveset.read(spark, where).filter("saveset = 'set-0.bck'")
    assert 0 < less.filter("intact").count() < 20
    events = saveset.read(spark, where, "events").filter("kind = 'MISSING'").collect()
    assert [(r.saveset, r.vol) for r in events] == [("set-0.bck", 2)]
    again = saveset.read(spark, where, add=f"file://{tmp_path}/away/other,file://{tmp_path}/away/x").filter("saveset = 'set-0.bck' AND intact")
    assert again.count() == 20 and whole == 40
    # one name is found behind the missing volume, since volumes go by their own numbers
    last = less.filter("intact").selectExpr("max(path)").first()[0]
    assert saveset.read(spark, where).filter(f"path = '{last}'").count() == 1
    ends = sorted((tmp_path / "sets").glob("set-0.bck*"))[-1]
    ends.write_bytes(ends.read_bytes()[: -8192])
    assert {r.kind for r in saveset.read(spark, where, "events").collect()} >= {"TRUNCATED"}
    assert saveset.read(spark, where, "summary").filter("whole").count() == 0


def test_a_file_is_read_from_its_place(spark, tmp_path):
    from sediment.sources import blocks

    entries = [({"path": b"f%d" % i, "ftype": 1, "mode": 0, "uid": 0, "gid": 0, "mtime": (0, 0)}, b"%d" % i * 3000) for i in range(300)]
    (data,) = blocks.write(entries, blocks.Layout(block=8192, group=3))
    seen = []

    def read(at, n):
        seen.append(n)
        return data[at : at + n]

    (file,) = blocks.file_named([blocks.Volume(read, len(data))], b"f138", [])
    assert file["content"] == b"138" * 3000 and file["intact"] and sum(seen) < len(data) // 8
    assert not list(blocks.file_named([blocks.Volume(read, len(data))], b"f399", []))


def test_holes_are_not_stored():
    from sediment.sources import blocks

    content = bytes(200_000) + b"x" + bytes(300_000) + b"y" * 70_000 + bytes(1 << 17)
    volumes = blocks.write([({"path": b"sparse", "ftype": 1, "mode": 0o600, "uid": 0, "gid": 0, "mtime": (0, 0)}, content), ({"path": b"none", "ftype": 1, "mode": 0, "uid": 0, "gid": 0, "mtime": (0, 0)}, bytes(1 << 20))], blocks.Layout(block=8192))
    assert sum(map(len, volumes)) < 300_000
    got = {f["path"]: f for f in blocks.files_of(volumes, [])}
    assert got[b"sparse"]["content"] == content and got[b"none"]["content"] == bytes(1 << 20) and all(f["intact"] for f in got.values())


def test_key_files(spark, tmp_path):
    from sediment.sources import crypto

    key = tmp_path / "key"
    key.write_text("first line\nsecond\n")
    key.chmod(0o644)
    with pytest.raises(PermissionError):
        crypto.passphrase_in(str(key))
    key.chmod(0o600)
    assert crypto.passphrase_in(str(key)) == b"first line"
    where = some_sets(spark, tmp_path, keys=crypto.Keys.derive(b"first line", rounds=1000))
    assert saveset.read(spark, where, keyFile=str(key)).filter("intact").count() == 40


def test_damaged_journals_are_told(spark, tmp_path):
    from sediment.sources import journal

    states = spark.createDataFrame([("/a/x", 1, 2, 3, 4, 5, 6, 7, 1, b"u" * 16, 8, 9), ("/a-b", 1, -2, 3, 4, 5, 6, 7, 3, b"u" * 16, 8, 9)], journal.SCHEMAS["states"])
    sets = spark.createDataFrame([(1, b"u" * 16, "/s/b.bck", 1, 2, 0, ["/", "/b"], 3, 4), (0, b"v" * 16, "/s/a.bck", None, None, 1, [], 0, 0)], journal.SCHEMAS["savesets"])
    path = tmp_path / "saves.jnl"
    assert journal.commit(sets, states, f"file://{path}") == 4
    first = path.read_bytes()
    got = journal.read(spark, f"file://{path}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, states.collect()))
    assert [(r.spec, r.bases, r.kind) for r in journal.read(spark, f"file://{path}", "savesets").orderBy("seq").collect()] == [("/s/a.bck", [], 1), ("/s/b.bck", ["/", "/b"], 0)]
    journal.commit(journal.read(spark, f"file://{path}", "savesets"), got.repartition(3), f"file://{path}")
    assert path.read_bytes() == first  # equal contents make equal files
    path.write_bytes(first[:40] + bytes([first[40] ^ 1]) + first[41:])
    with pytest.raises(Exception, match="damaged"):
        journal.read(spark, f"file://{path}").collect()
    nothing = tmp_path / "empty.jnl"
    journal.commit(sets.limit(0), states.limit(0), f"file://{nothing}")
    assert journal.read(spark, f"file://{nothing}").count() == 0


def test_restore_prunes_what_later_catalogs_lack(spark, tmp_path):
    from sediment.sources import blocks

    layout = blocks.Layout(block=8192)
    columns = "part int, path string, ftype int, content binary, status int"

    def link(k, kind, rows):
        saveset.write(spark.createDataFrame([(0, *r) for r in rows], columns), f"file://{tmp_path}/{k}", "part", layout, kind=kind).collect()
        return f"file://{tmp_path}/{k}"

    d, f = blocks.DIRECTORY, blocks.REGULAR
    chain = [
        link(0, blocks.FULL, [("d", d, None, 0), ("d/a", f, b"a0", 0), ("d/b", f, b"b0", 0), ("d/e", d, None, 0), ("d/e/x", f, b"x0", 0), ("top", f, b"t0", 0), ("g/y", f, b"y0", 0)]),
        link(1, blocks.INCREMENTAL, [("d", d, None, 0), ("d/a", f, None, blocks.PRESENT), ("d/c", f, b"c1", 0)]),
        link(2, blocks.INCREMENTAL, [("d", d, None, 0), ("d/a", f, b"a2", 0), ("d/c", f, None, blocks.PRESENT)]),
    ]
    got = {r.path: r.content for r in saveset.restore_chain(spark, chain).filter("ftype = 1").collect()}
    # d/b and all of d/e went with the first incremental; what is not in a listed directory stays
    assert got == {"d/a": b"a2", "d/c": b"c1", "top": b"t0", "g/y": b"y0"}


def test_deep_trees_are_cut_into_many_partitions(spark, tmp_path):
    want = set()
    for i in range(3):
        for j in range(30):
            (tmp_path / f"a{i}/b{j}/c").mkdir(parents=True)
            (tmp_path / f"a{i}/b{j}/c/f").write_text("x")
            want |= {f"a{i}", f"a{i}/b{j}", f"a{i}/b{j}/c", f"a{i}/b{j}/c/f"}
    found = fswalk.walk(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 1 + 3 + 90 and [r.path for r in found.select("path").collect()].__len__() == len(want) and {r.path for r in found.collect()} == want
    some = fswalk.walk(spark, str(tmp_path), exclude="a1,a2/b3*", maxDepth="3")
    assert {r.path for r in some.collect()} == {p for p in want if not p.startswith(("a1", "a2/b3")) and p.count("/") < 3}


def test_fast_codec_gives_up_early():
    from sediment.sources import codecs

    noise, text = os.urandom(1 << 17), b"some words " * 20_000
    assert codecs.pack(noise, codecs.LZ4) is None and codecs.pack(noise[: 1 << 16] + text, codecs.LZ4) is None
    assert len(codecs.pack(text, codecs.LZ4)) < 5000
