"""Savesets of the foreign backup format: blocks, repair, records, names and texts.

Records never cross blocks, so blocks of a repaired group decode on their own; files are the
runs of data records after their FILE record.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
HEADER_BYTES, LEVEL = 256, 0x0101
DATA_BLOCK, XOR_BLOCK = 1, 2
NO_CRC = 1
NULL, SUMMARY, FILE, VBN = 0, 1, 3, 4
DIRECTORY = 0x2000
FIXED, VARIABLE, VFC, STREAM, STREAM_LF, STREAM_CR = 1, 2, 3, 4, 5, 6
FORTRAN, CARRIAGE_RETURN, PRINT, NO_SPAN = 1, 2, 4, 8
BLOCK_SIZE, XOR_SIZE, SPEC, PROTECTION, CHARACTERISTICS, RECORD_ATTRIBUTES, REVISED = 13, 14, 42, 48, 51, 52, 55


def block_crc(block: bytes) -> int:
    return zlib.crc32(block[:36] + bytes(4) + block[40:254] + bytes(2) + block[256:])


def is_saveset(head: bytes) -> bool:
    """The first block's header: sizes, level, data block number 1, a block size in bounds."""
    if len(head) < HEADER_BYTES:
        return False
    size, _, _, applic, number = struct.unpack_from("<HHHHI", head)
    (bsize,) = struct.unpack_from("<I", head, 40)
    return size == HEADER_BYTES and struct.unpack_from("<H", head, 32)[0] == LEVEL and applic == DATA_BLOCK and number == 1 and 2048 <= bsize <= 65535


def valid(block: bytes, bsize: int) -> bool:
    """An XOR block is judged by its size field, kind and checksum alone."""
    if len(block) != bsize or struct.unpack_from("<H", block)[0] not in (HEADER_BYTES, 0):
        return False
    (applic,) = struct.unpack_from("<H", block, 6)
    crc, told, flags = struct.unpack_from("<III", block, 36)
    if applic != XOR_BLOCK and (struct.unpack_from("<H", block, 32)[0] != LEVEL or told != bsize or applic != DATA_BLOCK):
        return False
    return bool(applic != XOR_BLOCK and flags & NO_CRC) or crc == block_crc(block)


def attributes(body: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(body):
        size, kind = struct.unpack_from("<HH", body, at)
        if not size and not kind:
            return
        yield kind, body[at + 4 : at + 4 + size]
        at += 4 + size


def data_blocks(data: bytes, events: list) -> Iterator[bytes | None]:
    """Data blocks in order, one of a group rebuilt from its XOR block; null for a lost one."""
    if is_saveset(data):
        (bsize,) = struct.unpack_from("<I", data, 40)
    else:
        bsize = next((n for n in range(2048, 65536, 512) if len(data) % n == 0 and valid(data[n : 2 * n], n)), 0)
        if not bsize:
            raise ValueError("no saveset of this format")
    all_blocks = [data[a : a + bsize] for a in range(0, len(data), bsize)]
    good = [valid(b, bsize) for b in all_blocks]
    group = next((struct.unpack_from("<I", b, 8)[0] - 1 for b, g in zip(all_blocks, good, strict=True) if g and struct.unpack_from("<H", b, 6)[0] == XOR_BLOCK), 0)
    if good[0]:
        for kind, body in records(all_blocks[0], []):
            if kind[0] == SUMMARY:
                group = next((struct.unpack("<H", v)[0] for t, v in attributes(body) if t == XOR_SIZE), 0)
    for at in range(0, len(all_blocks), group + 1 if group else len(all_blocks)):
        span = list(range(at, min(len(all_blocks), at + (group + 1 if group else len(all_blocks)))))
        own = span[:-1] if group else span
        lost = [i for i in own if not good[i]]
        if group and len(lost) == 1 and good[span[-1]]:
            rest = np.zeros(bsize, np.uint8)
            for i in span:
                if i != lost[0]:
                    rest ^= np.frombuffer(all_blocks[i], np.uint8)
            fixed = bytearray(rest.tobytes())
            struct.pack_into("<H", fixed, 6, DATA_BLOCK)
            struct.pack_into("<I", fixed, 8, lost[0] + 1)
            all_blocks[lost[0]], lost = bytes(fixed), []
            events.append(("REPAIRED", at))
        for i in own:
            if i in lost:
                events.append(("LOST", i))
            yield None if i in lost else all_blocks[i]


def records(block: bytes, events: list) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((type, address), body) of the records of one block."""
    at = HEADER_BYTES
    while at + 16 <= len(block):
        size, kind, _, address, _ = struct.unpack_from("<HHIII", block, at)
        if kind == NULL:
            return
        if at + 16 + size > len(block):
            events.append(("BADREC", at))
            return
        yield (kind, address), block[at + 16 : at + 16 + size]
        at += 16 + size


def linux_name(spec: str, previous: str | None = None) -> str:
    """Path of a file specification; ``previous``: the specification before it, whose name may be the same."""

    def plain(part: str) -> str:
        def undo(m: re.Match) -> str:
            code = m[1]
            if code[0] == "U":
                return chr(int(code[1:], 16))
            return chr(int(code, 16)) if len(code) == 2 else " " if code == "_" else code

        part = re.sub(r"\^(U[0-9A-Fa-f]{4}|[0-9A-Fa-f]{2}|.)", undo, part)
        return part.replace("\0", "_").replace("/", "_")

    folder, name, version = re.fullmatch(r"\[((?:\^.|[^\]])*)\](.*?)(?:;(\d+))?", spec, re.S).groups()
    steps = [plain(s) for s in re.findall(r"(?:\^.|[^.^])+", folder) if s != "000000"]
    if ".." in steps:
        raise ValueError("a name that leads out")
    name = re.sub(r"(?<!\^)\.$", "", name)
    same = previous is not None and re.sub(r";\d+$", "", previous) == re.sub(r";\d+$", "", spec)
    return "/".join([*steps, plain(name) + (f";{version}" if same and version else "")])


def to_text(data: bytes, form: int, flags: int, size: int = 0, fixed_area: int = 2) -> bytes:
    """A file with carriage control as a text of lines; others as they are."""
    if not flags & (FORTRAN | CARRIAGE_RETURN | PRINT):
        return data
    if form == STREAM:
        return data.replace(b"\r\n", b"\n")
    if form == STREAM_CR:
        return data.replace(b"\r", b"\n")
    out, at = [], 0

    def line(record: bytes) -> None:
        if flags & FORTRAN:
            control, record = record[:1], record[1:]
            record = {b"0": b"\n", b"1": b"\f"}.get(control, b"") + record
        out.append(record + b"\n")

    if form in (VARIABLE, VFC):
        skip = fixed_area if form == VFC else 0
        while at + 2 <= len(data):
            (n,) = struct.unpack_from("<H", data, at)
            if n == 0xFFFF:
                at = (at // 512 + 1) * 512
                continue
            line(data[at + 2 + skip : at + 2 + n])
            at += 2 + n + n % 2
        return b"".join(out)
    if form == FIXED and size:
        while at < len(data):
            if flags & NO_SPAN and size <= 512 and at % 512 + size > 512:
                at = (at // 512 + 1) * 512
                continue
            line(data[at : at + size])
            at += size + size % 2
        return b"".join(out)
    return data


def files(data: bytes, events: list) -> Iterator[dict]:
    """Files in order: spec, path, form, flags, mask, content (as on the disk) and text; damaged where data are missing."""
    now, previous, gap = None, None, False

    def finished(f: dict) -> dict:
        content = bytes(f["content"][: f["bytes"]].ljust(f["bytes"], b"\0"))
        f |= {"content": content, "text": content if f["organization"] else to_text(content, f["form"], f["flags"], f["size"], f["fixed_area"])}
        f["damaged"] |= len(f.pop("got")) * 512 < f["bytes"]
        return f

    for block in data_blocks(data, events):
        if block is None:
            gap = True
            if now:
                now["damaged"] = True
            continue
        for (kind, address), body in records(block, events):
            if kind == FILE:
                if now:
                    yield finished(now)
                found = dict(attributes(body))
                fat = found.get(RECORD_ATTRIBUTES, bytes(32)).ljust(32, b"\0")
                high, low, free = struct.unpack_from("<HHH", fat, 8)
                end = high << 16 | low
                spec = found[SPEC].decode("latin-1")
                now = {"spec": spec, "path": linux_name(spec, previous), "form": fat[0] & 15, "organization": fat[0] >> 4, "flags": fat[1], "size": struct.unpack_from("<H", fat, 2)[0], "fixed_area": fat[15] or 2,
                       "bytes": max(0, (end - 1) * 512 + free) if end else 0, "used": end - (free == 0) if end else 0, "mask": int.from_bytes(found.get(PROTECTION, b"\0\0"), "little"),
                       "isdir": bool(int.from_bytes(found.get(CHARACTERISTICS, b"\0"), "little") & DIRECTORY), "revised": int.from_bytes(found.get(REVISED, b"\0"), "little"), "content": bytearray(), "got": set(), "damaged": False}
                previous, gap = spec, False
            elif kind == VBN and now:
                at = (address - 1) * 512
                if at < len(now["content"]):  # another file, whose FILE record was lost
                    yield finished(now)
                    now = None
                    continue
                now["damaged"] |= at > len(now["content"]) or gap
                gap = False
                now["content"] += bytes(at - len(now["content"])) + body
                now["got"] |= set(range(at // 512, (at + len(body)) // 512))
    if now:
        yield finished(now)


def as_variable(text: bytes) -> bytes:
    """A text as variable-length records (counts, pad octets)."""
    lines = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return b"".join(struct.pack("<H", len(x)) + x + b"\0" * (len(x) % 2) for x in lines)


def write(entries: list[tuple[str, bytes, int, int]], bsize: int = 8192, group: int = 10) -> bytes:
    """A saveset of (specification, content, record format, record attributes): what :func:`files` reads."""
    out, buffer = [], bytearray()

    def seal(body: bytes, kind: int) -> bytes:
        block = bytearray(bsize)
        struct.pack_into("<HHHHI", block, 0, HEADER_BYTES, 0x0800, 0, kind, len(out) + 1)
        struct.pack_into("<HHIII", block, 32, LEVEL, 1, 0, bsize, 0)
        block[HEADER_BYTES : HEADER_BYTES + len(body)] = body
        struct.pack_into("<I", block, 36, block_crc(bytes(block)))
        return bytes(block)

    members: list[bytes] = []

    def close_group() -> None:
        if not members or not group:
            return
        parity = np.zeros(bsize, np.uint8)
        for b in members:
            parity ^= np.frombuffer(b, np.uint8)
        block = bytearray(parity.tobytes())
        struct.pack_into("<H", block, 6, XOR_BLOCK)
        struct.pack_into("<I", block, 8, len(out) + 1)
        # fields that the repair sets again are zero in the sum, so that they cancel
        struct.pack_into("<I", block, 36, block_crc(bytes(block)))
        out.append(bytes(block))
        members.clear()

    def flush() -> None:
        nonlocal buffer
        if buffer:
            out.append(seal(bytes(buffer), DATA_BLOCK))
            members.append(out[-1])
            buffer = bytearray()
            if len(members) == group:
                close_group()

    def record(kind: int, body: bytes, address: int = 0) -> None:
        if len(buffer) + 16 + len(body) > bsize - HEADER_BYTES:
            flush()
        buffer.extend(struct.pack("<HHIII", len(body), kind, 0, address, 0) + body)

    def listed(items: list[tuple[int, bytes]]) -> bytes:
        return struct.pack("<H", LEVEL) + b"".join(struct.pack("<HH", len(v), t) + v for t, v in items) + bytes(4)

    record(SUMMARY, listed([(BLOCK_SIZE, struct.pack("<I", bsize)), (XOR_SIZE, struct.pack("<H", group))]))
    for spec, content, form, flags in entries:
        end, free = len(content) // 512 + 1, len(content) % 512
        fat = struct.pack("<BBHHHHHH", form, flags, 0, end >> 16, end & 0xFFFF, end >> 16, end & 0xFFFF, free).ljust(32, b"\0")
        record(FILE, listed([(SPEC, spec.encode("latin-1")), (RECORD_ATTRIBUTES, fat)]))
        padded, step = content + bytes(-len(content) % 512), (bsize - HEADER_BYTES - 16) // 512 * 512
        for at in range(0, len(padded), step):
            record(VBN, padded[at : at + step], at // 512 + 1)
    flush()
    close_group()
    return b"".join(out)


SCHEMA = "saveset string, seq long, spec string, path string, is_dir boolean, format int, organization int, attributes int, protection int, revised long, used long, size long, damaged boolean, content binary, text binary"


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self):
        from pyarrow import fs

        from sediment.sources.saveset import open_store

        store, where = open_store(self.path)
        prefix = self.path[: len(self.path) - len(where)]
        info = store.get_file_info(where)
        found = [i.path for i in store.get_file_info(fs.FileSelector(where)) if i.type == fs.FileType.File] if info.type == fs.FileType.Directory else [where]
        return [InputPartition(prefix + f) for f in sorted(found)] or [InputPartition("")]

    def read(self, partition):
        from sediment.sources.saveset import open_store

        if not partition.value:
            return
        store, where = open_store(partition.value)
        with store.open_input_stream(where, compression=None) as handle:
            data = handle.read()
        if not is_saveset(data[:HEADER_BYTES]):
            return  # another kind of file
        for seq, f in enumerate(files(data, [])):
            yield where.rpartition("/")[2], seq, f["spec"], f["path"], f["isdir"], f["form"], f["organization"], f["flags"], f["mask"], f["revised"], f["used"], f["bytes"], f["damaged"], f["content"], f["text"]


class VmsSource(DataSource):
    """Savesets of the foreign format below a folder, one partition each; other files are passed by."""

    @classmethod
    def name(cls):
        return "vms"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VmsSource)
    return spark.read.format("vms").options(path=path).load()


def named(wanted: str) -> Column:
    """Whether a file is the one that is wanted: its path, its path with the version, or its specification in any case."""
    path, version = F.col("path"), F.regexp_extract("spec", r";(\d+)$", 1)
    plain = F.when((version != "") & path.endswith(F.concat(F.lit(";"), version)), F.expr("regexp_replace(path, ';[0-9]+$', '')")).otherwise(path)
    return (F.upper("spec") == wanted.upper()) | (plain == wanted) | (F.concat(plain, F.lit(";"), version) == wanted)


def write_sets(rows: DataFrame, folder: str) -> DataFrame:
    """A saveset below ``folder`` for each ``part`` of (part, spec, content, format, attributes); (saveset, bytes)."""
    import pyarrow as pa

    from sediment.sources.saveset import open_store

    store, where = open_store(folder)
    store.create_dir(where, recursive=True)

    def save(key, table):
        name = f"set-{key[0].as_py()}.sav"
        listed = sorted(zip(*(table[c].to_pylist() for c in ("spec", "content", "format", "attributes")), strict=True))
        data = write(listed)
        target, at = open_store(folder)
        with target.open_output_stream(f"{at}/{name}", compression=None) as out:
            out.write(data)
        return pa.table({"saveset": [name], "bytes": pa.array([len(data)], pa.int64())})

    return rows.groupBy("part").applyInArrow(save, "saveset string, bytes long")


def variable_text(text: Column) -> Column:
    """Texts as variable-length records."""
    @F.pandas_udf("binary")
    def make(x: pd.Series) -> pd.Series:
        return x.map(as_variable)

    return make(text)
