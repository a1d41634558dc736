"""The journal of saves: a file of saveset and file states, and its rebuild from catalogs.

The file has a header, SSET records in the order they came, FSTATE records in the order of their
names, and a CRC of all of it. At scale the journal is two tables; the file is one stream, so one task reads
or writes it, with one record in memory.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sediment.operators.snapshots import latest
from sediment.sources import blocks, saveset

#: Fixed values of the format.
MAGIC = b"VBKJ"
HEADER = struct.Struct("<4sHHQ")
RECORD = struct.Struct("<HHI")
SSET, FSTATE = 16, 17

SCHEMAS = {
    "savesets": "seq long, ssuuid binary, spec string, created_sec long, created_nsec int, kind int, bases array<string>, nfiles long, nbytes long",
    "states": "path string, dev long, ino long, ctime_sec long, ctime_nsec int, mtime_sec long, mtime_nsec int, size long, ftype int, ssuuid binary, recorded_sec long, recorded_nsec int",
}


def checked(handle) -> int:
    """The number of records of a journal whose CRC is right; reads it once, in pieces."""
    size = handle.size()
    if size < HEADER.size + 4:
        raise ValueError("too short for a journal")
    crc = 0
    for at in range(0, size - 4, 1 << 20):
        crc = zlib.crc32(handle.read_at(min(1 << 20, size - 4 - at), at), crc)
    magic, version, _, count = HEADER.unpack(handle.read_at(HEADER.size, 0))
    if magic != MAGIC or version != 1 or struct.unpack("<I", handle.read_at(4, size - 4))[0] != crc:
        raise ValueError("no journal, or a damaged one")
    return count


def records(handle) -> Iterator[tuple[int, dict]]:
    """(type, items) of each record; stops before one that runs past the end."""
    at, end = HEADER.size, handle.size() - 4
    for _ in range(checked(handle)):
        if at + RECORD.size > end:
            return
        kind, _, size = RECORD.unpack(handle.read_at(RECORD.size, at))
        at += RECORD.size
        if at + size > end:
            return
        yield kind, blocks.tlv_items(handle.read_at(size, at))
        at += size


def head(count: int) -> bytes:
    return HEADER.pack(MAGIC, 1, 0, count)


def record(code: int, /, **items) -> bytes:
    body = blocks.tlv(**items)
    return RECORD.pack(code, 0, len(body)) + body


def sset_record(r: dict) -> bytes:
    created = None if r["created_sec"] is None else (r["created_sec"], r["created_nsec"] or 0)
    return record(SSET, ssuuid=r["ssuuid"], spec=r["spec"].encode(), created=created, kind=r["kind"], base=[b.encode() for b in r["bases"] or []], nfiles=r["nfiles"], nbytes=r["nbytes"])


def state_record(r: dict) -> bytes:
    times = {t: (r[f"{t}_sec"] or 0, r[f"{t}_nsec"] or 0) for t in ("ctime", "mtime", "recorded")}
    return record(FSTATE, path=r["path"].encode(), devino=struct.pack("<qq", r["dev"], r["ino"]), size=r["size"], ftype=r["ftype"], ssuuid=r["ssuuid"], **times)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "states")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        store, where = saveset.open_store(self.path)
        with store.open_input_file(where) as handle:
            for seq, (kind, r) in enumerate(records(handle)):
                if kind == SSET and self.table == "savesets":
                    yield seq, r.get("ssuuid"), saveset.text(r.get("spec")), *r.get("created", (None, None)), r.get("kind"), [saveset.text(b) for b in r.get("base", [])], r.get("nfiles"), r.get("nbytes")
                elif kind == FSTATE and self.table == "states" and r.get("path"):
                    inode = struct.unpack("<qq", r["devino"]) if len(r.get("devino", b"")) == 16 else (0, 0)
                    yield saveset.text(r["path"]), *inode, *r.get("ctime", (0, 0)), *r.get("mtime", (0, 0)), r.get("size", 0), r.get("ftype", 0), r.get("ssuuid"), *r.get("recorded", (0, 0))


class JournalSource(DataSource):
    @classmethod
    def name(cls):
        return "journal"

    def schema(self):
        return SCHEMAS[self.options.get("table", "states")]

    def reader(self, schema):
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str, table: str = "states") -> DataFrame:
    """``savesets`` or ``states`` of a journal file. A damaged file is an error."""
    spark.dataSource.register(JournalSource)
    return spark.read.format("journal").options(path=path, table=table).load()


def commit(savesets: DataFrame, states: DataFrame, path: str) -> int:
    """Write a journal: to a name beside it, then renamed over it; returns the number of its records.

    ``savesets`` keeps the order of its ``seq``, states are sorted by name; equal contents make equal files.
    """
    import pyarrow as pa

    of_sets = [r.asDict() for r in savesets.orderBy("seq").collect()]  # one row for each saveset ever recorded
    n_states = states.count()
    total = len(of_sets) + n_states
    own = f"{path}.{uuid.uuid4().hex}.tmp"

    def write(batches):
        store, where = saveset.open_store(own)
        crc, n = 0, 0
        with store.open_output_stream(where, compression=None) as out:
            def put(data):
                nonlocal crc
                crc = zlib.crc32(data, crc)
                out.write(data)

            put(head(total))
            for r in of_sets:
                put(sset_record(r))
            for batch in batches:
                for r in batch.to_pylist():
                    put(state_record(r))
                    n += 1
            out.write(struct.pack("<I", crc))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # one file is one stream: one task, which sorts with spilling and writes as it goes
    in_order = states.select(*(f.split()[0] for f in SCHEMAS["states"].split(", "))).repartition(1).sortWithinPartitions(F.encode("path", "utf-8"))
    written = sum(r.n for r in in_order.mapInArrow(write, "n long").collect()) if n_states else sum(b.column(0)[0].as_py() for b in write([]))
    if written != n_states:
        raise RuntimeError("the states changed while they were written")
    store, where = saveset.open_store(path)
    store.move(saveset.open_store(own)[1], where)
    return total


def rebuilt(spark: SparkSession, folder: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(savesets, states) that the catalogs below ``folder`` tell.

    Entries saved OK, no directories, with an absolute base, a change time and an inode. Of one name the saveset made later
    wins, by the second; of equals the one named later, then the later entry. Savesets without a trailer are left out.
    """
    found = saveset.read(spark, folder, "summary", **options).filter("whole")
    place = F.concat(F.lit(folder.rstrip("/") + "/"), "saveset")
    entries = saveset.read(spark, folder, "catalog", **options).filter((F.col("status") == blocks.OK) & (F.col("ftype") != blocks.DIRECTORY) & F.col("ctime_sec").isNotNull() & F.col("ino").isNotNull())
    known = entries.join(found.select("saveset", "ssuuid", "created_sec", "created_nsec", "bases"), "saveset").withColumn("base", F.get("bases", "baseidx")).filter(F.col("base").startswith("/"))
    path = F.concat("base", F.when(F.col("base") == "/", "").otherwise("/"), "path")
    states = known.select(path.alias("path"), "dev", "ino", "ctime_sec", "ctime_nsec", "mtime_sec", "mtime_nsec", "size", "ftype", "ssuuid", F.col("created_sec").alias("recorded_sec"), F.col("created_nsec").alias("recorded_nsec"), "saveset", "seq")
    states = latest(states, ["path"], ["recorded_sec", "saveset", "seq"]).drop("saveset", "seq")
    by_name = F.row_number().over(Window.orderBy("saveset"))  # one row a saveset
    savesets = found.select((by_name - 1).cast("long").alias("seq"), "ssuuid", place.alias("spec"), "created_sec", "created_nsec", "kind", "bases", "nfiles", "nbytes")
    return savesets, states
