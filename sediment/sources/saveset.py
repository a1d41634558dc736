"""Data source ``saveset``: a folder of savesets as tables.

Options: ``path`` (a folder or one first volume, any URI), ``table`` (files, records, blocks,
catalog, summary or events), ``passphrase`` or ``keyFile`` (read on the driver) and ``keyLabel`` for encrypted savesets,
``add`` (comma-separated volumes found elsewhere: each takes the place that its header names, if it is of the same saveset). One saveset is one partition, planned on the driver from the folder's
names; blocks of one volume are one partition. A task reads by place and holds one group of blocks. An exact filter on ``saveset`` prunes partitions;
an exact filter on ``path`` of files goes by the trailer and the catalog to the records of that name and reads nothing else.
Catalogs and summaries are read from where the trailer says they are. A volume that is missing or cut short is an
event, never an error.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from sediment.sources import blocks, crypto

SCHEMAS = {
    "files": "saveset string, fileno long, path string, ftype int, mode int, uid long, gid long, size long, mtime_sec long, mtime_nsec int, link string, crc long, status int, intact boolean, content binary",
    "records": "saveset string, seq long, vol int, blk long, off int, type int, len long, resync boolean, insolid boolean, body binary",
    "blocks": "saveset string, vol int, pos long, version int, type int, flags int, gindex int, blkno long, recoff long, paylen long, prvrecoff long, prvpaylen long, ok boolean, payload binary",
    "catalog": "saveset string, seq long, fileno long, path string, ftype int, mode int, uid long, gid long, size long, mtime_sec long, mtime_nsec int, ctime_sec long, ctime_nsec int, dev long, ino long, baseidx int, link string, crc long, status int, locvol int, locblk long, locoff int, solid int",
    "summary": "saveset string, ssuuid binary, product string, kind int, created_sec long, created_nsec int, bases array<string>, block int, group int, parity int, whole boolean, nfiles long, nbytes long, nerrors long, nblocks long, nvols int, nentries long",
    "events": "saveset string, kind string, vol int, blk long",
}
MOST_MISSING = 16


def text(value: bytes | None) -> str | None:
    return None if value is None else value.decode(errors="replace")


class Saveset(InputPartition):
    def __init__(self, name: str, volumes: list[str]):
        super().__init__((name, volumes))
        self.name, self.volumes = name, volumes


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def opened(path: str) -> blocks.Volume:
    """A volume that is read by place."""
    store, where = open_store(path)
    handle = store.open_input_file(where)
    return blocks.Volume(lambda at, n: handle.read_at(n, at), handle.size())


def volumes_below(path: str) -> list[tuple[str, list[str]]]:
    """(name, volumes in order) of each saveset of a folder, or of one first volume; listed on the driver."""
    from pyarrow import fs

    store, where = open_store(path)
    prefix = path[: len(path) - len(where)]
    info = store.get_file_info(where)
    folder = info.type == fs.FileType.Directory
    found = store.get_file_info(fs.FileSelector(where if folder else where.rpartition("/")[0]))
    names = {i.path for i in found if i.type == fs.FileType.File}
    out = []
    for first in sorted(n for n in names if n.endswith(".bck")) if folder else [where]:
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(re.escape(first) + r"\.(\d{3,})", n)))
        volumes, last = [prefix + first], 1
        for k in numbers:
            if k - last > MOST_MISSING:
                break
            volumes.append(f"{prefix}{first}.{k:03d}")
            last = k
        out.append((first.rpartition("/")[2], volumes))
    return out


def head_of(path: str):
    """(saveset, volume number) that the header of a volume names; nulls if it is lost."""
    volume = opened(path)
    known = blocks.summary_of(volume)
    block = blocks.opened(volume[: known[0]], known[0]) if known else None
    return (block.ssuuid, block.volno) if block else (None, None)


def with_added(volumes: list[str], added: list[str]) -> list[str]:
    """Volumes of a saveset with those of ``added`` that are of it, by number; one that is there already stays."""
    if not added:
        return volumes
    heads = [(v, *head_of(v)) for v in volumes]
    own = next((s for _, s, _ in heads if s), None)
    places = {number or k: v for k, (v, _, number) in enumerate(heads, 1)}
    for path in added:
        of_set, number = head_of(path)
        if of_set is not None and of_set == own:
            places.setdefault(number, path)
    return [places[k] for k in sorted(places)]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"].rstrip("/"), options.get("table", "files")
        secret = options["passphrase"].encode() if options.get("passphrase") else None
        if secret is None and options.get("keyfile"):
            secret = crypto.passphrase_in(options["keyfile"])
        self.added = [v for v in options.get("add", "").split(",") if v]
        self.key = {"passphrase": secret, "label": options.get("keylabel", "SEDIMENT")}
        self.only: set[str] | None = None
        self.named: str | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("saveset",):
                self.only = {f.value}
            else:
                if isinstance(f, EqualTo) and f.attribute == ("path",) and self.table == "files":
                    self.named = f.value
                yield f

    def partitions(self):
        out = []
        for name, volumes in volumes_below(self.path):
            if self.only is None or name in self.only:
                volumes = with_added(volumes, self.added)
                out += [Saveset(name, [v]) for v in volumes] if self.table == "blocks" else [Saveset(name, volumes)]
        return out or [Saveset("", [])]

    def read(self, partition):
        if not partition.volumes:
            return
        volumes, events = [opened(v) for v in partition.volumes], []
        name = partition.name
        if self.table == "blocks":
            yield from self.blocks(name, volumes[0])
        elif self.table == "records":
            for seq, (kind, body, vol, blk, off, resync, insolid) in enumerate(blocks.records_of(volumes, events, **self.key)):
                yield name, seq, vol, blk, off, kind, len(body), resync, insolid, body
        elif self.table == "files":
            found = blocks.files_of(volumes, events, **self.key) if self.named is None else blocks.file_named(volumes, self.named.encode(), events, **self.key)
            for f in found:
                sec, nsec = f.get("mtime", (None, None))
                yield name, f["fileno"], text(f["path"]), f["ftype"], f.get("mode"), f.get("uid"), f.get("gid"), len(f["content"]), sec, nsec, text(f.get("link")), f["crc"], f["status"], f["intact"], f["content"]
        elif self.table == "catalog":
            for seq, e in enumerate(blocks.catalog_of(volumes, events, **self.key)):
                times = (*e.get("mtime", (None, None)), *e.get("ctime", (None, None)))
                inode = struct.unpack("<qq", e["devino"]) if len(e.get("devino", b"")) == 16 else (None, None)
                owner = (e.get("mode"), e.get("uid"), e.get("gid"), e.get("size"))
                yield name, seq, e["fileno"], text(e["path"]), e["ftype"], *owner, *times, *inode, e.get("baseidx", 0), text(e.get("link")), e.get("crc"), e.get("status"), e.get("locvol"), e.get("locblk"), e.get("locoff"), e.get("solid")
        elif self.table == "summary":
            yield self.summary(name, volumes)
        else:
            seen = [head_of(v)[1] or k for k, v in enumerate(partition.volumes, 1)]
            events += [("MISSING", k, 0) for k in range(1, seen[-1]) if k not in seen]
            if blocks.trailer_of(volumes, **self.key) is None:
                events.append(("TRUNCATED", seen[-1], 0))
            for _ in blocks.records_of(volumes, events, **self.key):
                pass
            for event in events:
                yield (name, *event)

    def summary(self, name: str, volumes: list) -> tuple:
        """What the SUMMARY record and the trailer say; ``whole``: there is a trailer."""
        end = blocks.trailer_of(volumes, **self.key) or {}
        first = next((body for kind, body, *_ in blocks.records_of(volumes, [], **self.key) if kind == blocks.SUMMARY), None)
        head = blocks.tlv_items(first) if first is not None else {}
        of_set = next((b.ssuuid for v in volumes if (s := blocks.summary_of(v)) and (b := blocks.opened(v[: s[0]], s[0]))), None)
        bases = [text(b) for b in head.get("base", [])]
        told = (head.get("blocksize"), head.get("groupsize"), head.get("parity", 1), bool(end))
        return name, of_set, text(head.get("product")), head.get("kind"), *head.get("created", (None, None)), bases, *told, *(end.get(k) for k in ("nfiles", "nbytes", "nerrors", "nblocks", "nvols", "nentries"))

    def blocks(self, name: str, volume):
        known = blocks.summary_of(volume)
        size = known[0] if known else blocks.guessed_size(volume)
        for pos in range(len(volume) // size if size else 0):
            b = blocks.opened(volume[pos * size : (pos + 1) * size], size)
            if b is None:
                yield (name, None, pos, *[None] * 9, False, None)
            else:
                yield name, b.volno, pos, b.version, b.type, b.flags, b.gindex, b.blkno, b.recoff, b.paylen, b.prvrecoff, b.prvpaylen, True, b.payload


class SavesetSource(DataSource):
    @classmethod
    def name(cls):
        return "saveset"

    def schema(self):
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema):
        return Reader({k.lower(): v for k, v in self.options.items()})  # names of options have no case


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavesetSource)


def read(spark: SparkSession, path: str, table: str = "files", **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("saveset").options(path=path, table=table, **options).load()


WRITTEN = "saveset string, volumes int, files long, bytes long"
#: Columns that :func:`write` takes besides path and content, and what stands for them where they are missing or null.
OPTIONAL = {"ftype": blocks.REGULAR, "mode": 0o644, "uid": 0, "gid": 0, "mtime_sec": 0, "mtime_nsec": 0, "ctime_sec": None, "ctime_nsec": 0, "dev": None, "ino": None, "baseidx": None, "link": None, "status": blocks.OK, "size": 0}


def attributes_of(row: dict) -> dict:
    """Attributes of an entry as its records hold them."""
    row = {c: default if row.get(c) is None else row[c] for c, default in OPTIONAL.items()} | {"path": row["path"]}
    out = {"path": row["path"].encode(), **{c: row[c] for c in ("ftype", "mode", "uid", "gid", "baseidx")}, "mtime": (row["mtime_sec"], row["mtime_nsec"])}
    if row["ctime_sec"] is not None:
        out["ctime"] = (row["ctime_sec"], row["ctime_nsec"])
    if row["dev"] is not None and row["ino"] is not None:
        out["devino"] = struct.pack("<qq", row["dev"], row["ino"])
    if row["link"] is not None:
        out["link"] = row["link"].encode()
    if row["status"] != blocks.OK:
        out["status"] = row["status"]
    if row["status"] == blocks.PRESENT:
        out["size"] = row["size"]
    return out


def write(files: DataFrame, folder: str, by: str, layout: blocks.Layout, **summary) -> DataFrame:
    """One saveset below ``folder`` for each value of ``by``; returns what was written.

    ``files`` has path and content (binary) and may have the columns of OPTIONAL; a status of PRESENT
    makes a catalog entry without content. Entries are written in walk order of their paths. ``summary``: items
    of the SUMMARY record such as created, base and kind. Saves are independent, so the number of them sets the parallelism; a save holds one
    saveset in memory, so ``by`` should cut the input into savesets of bounded size.
    """
    import dataclasses
    import hashlib

    import pyarrow as pa

    store, where = open_store(folder)
    store.create_dir(where, recursive=True)
    more = [c for c in OPTIONAL if c in files.columns]

    def save(key, table):
        name = f"set-{key[0].as_py()}.bck"
        rows = sorted(table.to_pylist(), key=lambda r: r["path"].split("/"))
        own = dataclasses.replace(layout, ssuuid=hashlib.md5(f"{folder}/{name}".encode()).digest())
        volumes = blocks.write(((attributes_of(r), r["content"]) for r in rows), own, **summary)
        target, at = open_store(folder)
        for k, volume in enumerate(volumes, 1):
            with target.open_output_stream(f"{at}/{name}" + (f".{k:03d}" if k > 1 else ""), compression=None) as out:
                out.write(volume)
        saved = [r for r in rows if r.get("status") != blocks.PRESENT]
        return pa.table({"saveset": [name], "volumes": pa.array([len(volumes)], pa.int32()), "files": [len(saved)], "bytes": [sum(len(r["content"] or b"") for r in saved)]})

    return files.select(by, "path", "content", *more).groupBy(by).applyInArrow(save, WRITTEN)


COPIED = "saveset string, volume string, blocks long, bad long"


def transfer(spark: SparkSession, source: str, target: str, change=None) -> DataFrame:
    """Every volume below ``source`` copied block for block; (saveset, volume, blocks, bad) of each.

    A block that is not valid is copied as it is and counted. A volume is one task's work and one block
    is in memory; it is written under a name of the task's own and renamed when it is whole, so a task that is run again
    does no harm. ``change(place, blocks of the volume, block)`` may replace a block's bytes (for tests of damage).
    """
    import uuid

    import pyarrow as pa

    store, where = open_store(target)
    store.create_dir(where, recursive=True)
    todo = [(name, v) for name, volumes in volumes_below(source) for v in volumes]

    def copy(batches):
        for batch in batches:
            out = []
            for name, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                volume = opened(path)
                known = blocks.summary_of(volume)
                size = known[0] if known else blocks.guessed_size(volume) or len(volume)
                files, folder = open_store(target)
                own, bad, count = f"{folder}/.{uuid.uuid4().hex}", 0, 0
                with files.open_output_stream(own, compression=None) as to:
                    for at in range(0, len(volume), size):
                        block = volume[at : at + size]
                        block = change(at // size, -(-len(volume) // size), block) if change else block
                        bad += blocks.opened(block, size) is None
                        count += 1
                        to.write(block)
                files.move(own, f"{folder}/{path.rpartition('/')[2]}")
                out.append((name, path.rpartition("/")[2], count, bad))
            names, volumes, counts, bads = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(volumes, pa.string()), pa.array(counts, pa.int64()), pa.array(bads, pa.int64())], names=["saveset", "volume", "blocks", "bad"])

    listed = spark.createDataFrame(todo, "saveset string, path string").repartition(max(1, len(todo)), "path") if todo else spark.createDataFrame([], "saveset string, path string")
    return listed.mapInArrow(copy, COPIED)


def as_streams(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Each saveset below ``source`` as one file below ``target``, its volumes one after the other; (saveset, bytes)."""
    import pyarrow as pa

    store, where = open_store(target)
    store.create_dir(where, recursive=True)
    todo = [(name, volumes) for name, volumes in volumes_below(source)]

    def join(batches):
        for batch in batches:
            out = []
            for name, volumes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, folder = open_store(target)
                total = 0
                with files.open_output_stream(f"{folder}/{name}.stream", compression=None) as to:
                    for path in volumes:
                        volume = opened(path)
                        for at in range(0, len(volume), 1 << 20):
                            total += to.write(volume[at : at + (1 << 20)])
                out.append((name, total))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([t for _, t in out], pa.int64())], names=["saveset", "bytes"])

    return spark.createDataFrame(todo, "saveset string, volumes array<string>").repartition(max(1, len(todo)), "saveset").mapInArrow(join, "saveset string, bytes long")


def split_streams(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Volumes out of streams, read forward only: every good header of another number begins a volume, a stream that ends early is told.

    (saveset, volumes, blocks, bad, whole); ``whole``: a trailer was the last block.
    """
    import pyarrow as pa
    from pyarrow import fs

    store, where = open_store(source)
    prefix = source[: len(source) - len(where)]
    todo = [(prefix + i.path,) for i in store.get_file_info(fs.FileSelector(where)) if i.path.endswith(".stream")]
    to_store, folder = open_store(target)
    to_store.create_dir(folder, recursive=True)

    def split_one(path: str) -> tuple:
        files, folder = open_store(target)
        name = path.rpartition("/")[2].removesuffix(".stream")
        stores, where = open_store(path)
        out, number, count, bad, last = None, 0, 0, 0, None
        with stores.open_input_stream(where, compression=None) as stream:
            first = stream.read(64)
            size = blocks.HEADER.unpack(first)[3] if len(first) == 64 and first[:4] == blocks.MAGIC else 0
            if not size:
                raise ValueError(f"{path} is no saveset")
            data = first + stream.read(size - 64)
            while data:
                last = blocks.opened(data, size)
                if last is not None and last.type == blocks.VHDR and last.volno != number:
                    if out is not None:
                        out.close()
                    number = last.volno
                    out = files.open_output_stream(f"{folder}/{name}" + (f".{number:03d}" if number > 1 else ""), compression=None)
                if out is None:
                    raise ValueError(f"{path} does not begin with a header")
                bad += last is None
                count += 1
                out.write(data)
                data = stream.read(size)
            out.close()
        return name, number, count, bad, last is not None and last.type in (blocks.TRAILER, blocks.ETRAILER) and bool(last.flags & blocks.LAST_IN_SET)

    def split_all(batches):
        for batch in batches:
            rows = [split_one(p) for p in batch.column("path").to_pylist()]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["saveset", "volumes", "blocks", "bad", "whole"])

    listed = spark.createDataFrame(todo, "path string").repartition(max(1, len(todo)), "path")
    return listed.mapInArrow(split_all, "saveset string, volumes int, blocks long, bad long, whole boolean")


def restore_chain(spark: SparkSession, folders: list[str], **options: str) -> DataFrame:
    """The files after restoring savesets, oldest folder first: path, link number and all columns of files.

    The last link that saved a path wins. An INCREMENTAL link removes what its catalog lacks from
    directories that it has, and all below what it removes; top-level entries stay.
    """
    from functools import reduce

    links = [(i, read(spark, f, "files", **options), read(spark, f, "catalog", **options), read(spark, f, "summary", **options)) for i, f in enumerate(folders)]
    number = lambda i: F.lit(i).alias("chain")
    files = reduce(DataFrame.unionByName, (f.select(number(i), "*") for i, f, _, _ in links))
    names = reduce(DataFrame.unionByName, (c.select(number(i), "path", "ftype") for i, _, c, _ in links))
    pruning = reduce(DataFrame.unionByName, (s.select(number(i), "kind") for i, _, _, s in links)).groupBy("chain").agg(F.min("kind").alias("kind")).filter(F.col("kind") == blocks.INCREMENTAL)
    saved = files.groupBy("path").agg(F.max("chain").alias("chain"))
    # every entry above a path, and the path itself, in each later pruning link (a few rows: one for each link)
    depth = F.size(F.split("path", "/"))
    above = F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")))
    later = saved.join(F.broadcast(pruning.select(F.col("chain").alias("later"))), F.col("later") > F.col("chain"))
    steps = later.select("path", "chain", "later", above.alias("entry")).withColumn("parent", F.regexp_replace("entry", "/[^/]*$", "")).filter("entry <> parent")
    dirs = names.filter(F.col("ftype") == blocks.DIRECTORY).select(F.col("chain").alias("later"), F.col("path").alias("parent")).distinct()
    there = names.select(F.col("chain").alias("later"), F.col("path").alias("entry")).distinct()
    gone = steps.join(dirs, ["later", "parent"], "left_semi").join(there, ["later", "entry"], "left_anti").select("path").distinct()
    return files.join(saved, ["path", "chain"], "left_semi").join(gone, "path", "left_anti")
