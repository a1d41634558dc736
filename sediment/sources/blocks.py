"""Blocks, groups and records of a saveset: plain functions over bytes.

A saveset is one or more volumes of equal blocks: a volume header, groups of data blocks with
their parity blocks, and a trailer at the end. Data payloads in order form a stream of records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from sediment.sources import codecs, crypto, galois

#: Fixed values of the format.
MAGIC = b"VBKB"
HEADER = struct.Struct("<4sHHIBBH16sQIIIIII")
DATA, XOR, VHDR, TRAILER, EDATA, ETRAILER, PARITY = 1, 2, 3, 4, 5, 6, 7
SUMMARY, FILE, DATA_RECORD, FEND, CATALOG, END, DATAZ, SOLID = 1, 2, 3, 4, 5, 6, 7, 8
NONE = 0xFFFFFFFF
LAST_IN_VOLUME, LAST_IN_SET = 1, 2
#: States of a catalog entry; PRESENT: covered, but saved by an earlier saveset.
OK, CHANGED, READ_ERROR, PRESENT = 0, 1, 2, 3
REGULAR, DIRECTORY, SYMBOLIC_LINK, HARD_LINK = 1, 2, 3, 4
FULL, INCREMENTAL = 0, 1
MAX_RECORD, MAX_DATA, MAX_SOLID_RAW, MAX_SOLID = 16 << 20, 1 << 20, 1_114_112, 262_144
PIECE = 1 << 16
TAGS = {
    "fileno": 1, "path": 2, "ftype": 3, "mode": 4, "uid": 5, "gid": 6, "uname": 7, "gname": 8, "size": 9, "mtime": 10, "atime": 11, "ctime": 12, "btime": 13, "rdev": 14, "link": 15,
    "xattr": 16, "fsflags": 17, "devino": 18, "baseidx": 19, "nlink": 20, "winattr": 21, "ntsd": 22, "solid": 23, "crc": 32, "status": 33, "locvol": 34, "locblk": 35, "locoff": 36,
    "product": 64, "created": 68, "base": 69, "blocksize": 70, "groupsize": 71, "volsize": 72, "comment": 73, "kind": 75, "filter": 76, "compress": 77, "cipher": 88, "kdf": 89, "kdfiter": 90, "salt": 91, "keycheck": 92, "parity": 93,
    "nfiles": 96, "nbytes": 97, "nerrors": 98, "nblocks": 99, "catvol": 100, "catblk": 101, "catoff": 102, "nvols": 103, "nentries": 104, "ssuuid": 128, "spec": 129, "recorded": 130,
}
WIDTHS = {"ftype": 1, "solid": 1, "status": 1, "kind": 1, "compress": 1, "cipher": 1, "kdf": 1, "parity": 1, "baseidx": 2, "size": 8, "rdev": 8, "locblk": 8, "volsize": 8, "nfiles": 8, "nbytes": 8, "nblocks": 8, "catblk": 8, "nentries": 8}
RAW = {"path", "uname", "gname", "link", "xattr", "ntsd", "product", "base", "comment", "filter", "devino", "salt", "keycheck", "ssuuid", "spec"}
TIMES = {"mtime", "atime", "ctime", "btime", "created", "recorded"}
NAMES = {v: k for k, v in TAGS.items()}


def tlv(**items) -> bytes:
    """TLV items in tag order; lists repeat a tag; times are (seconds, nanoseconds)."""
    out = []
    for name in sorted(items, key=TAGS.__getitem__):
        value = items[name]
        if value is None:
            continue
        for one in value if isinstance(value, list) else [value]:
            body = struct.pack("<qI", *one) if name in TIMES else one if name in RAW else int(one).to_bytes(WIDTHS.get(name, 4), "little")
            out.append(struct.pack("<HI", TAGS[name], len(body)) + body)
    return b"".join(out)


def tlv_items(body: bytes) -> dict:
    """Known items by name (repeated ones as lists) and unknown ones under ``extra``."""
    out: dict = {"extra": {}}
    at = 0
    while at + 6 <= len(body):
        tag, size = struct.unpack_from("<HI", body, at)
        value = body[at + 6 : at + 6 + size]
        if len(value) < size:
            raise ValueError("an item runs past the end")
        at += 6 + size
        name = NAMES.get(tag)
        if name is None:
            out["extra"][tag] = value
        elif name in ("xattr", "base"):
            out.setdefault(name, []).append(value)
        elif name in TIMES:
            out[name] = struct.unpack("<qI", value) if size == 12 else (0, 0)
        else:
            out[name] = value if name in RAW else int.from_bytes(value, "little") if size in (1, 2, 4, 8) else 0
    return out


class Volume:
    """Bytes of a volume, read by place; slices work as on ``bytes``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        return self.read(start, stop - start) if stop > start else b""


@dataclass
class Block:
    type: int
    blkno: int
    volno: int
    payload: bytes = b""
    gindex: int = 0
    recoff: int = 0
    flags: int = 0
    prvrecoff: int = NONE
    prvpaylen: int = 0
    paylen: int = -1
    version: int = 1
    ssuuid: bytes = bytes(16)

    @property
    def used(self) -> int:
        return len(self.payload) if self.paylen < 0 else self.paylen

    def sealed(self, size: int) -> bytes:
        paylen = len(self.payload) if self.paylen < 0 else self.paylen
        body = self.payload.ljust(size - 64, b"\0")
        head = [MAGIC, 64, self.version, size, self.type, self.flags, self.gindex, self.ssuuid, self.blkno, self.volno, self.recoff, paylen, self.prvrecoff, self.prvpaylen, 0]
        head[-1] = zlib.crc32(HEADER.pack(*head) + body)
        return HEADER.pack(*head) + body


def opened(data: bytes, size: int, ssuuid: bytes | None = None) -> Block | None:
    """The block if it is valid, else null. Bytes after ``paylen`` of data count as zeros."""
    if len(data) != size or data[:4] != MAGIC:
        return None
    _, hdrlen, version, bsize, kind, flags, gindex, owner, blkno, volno, recoff, paylen, prvrecoff, prvpaylen, crc = HEADER.unpack_from(data)
    if hdrlen != 64 or bsize != size or version not in (1, 2, 3) or ssuuid not in (None, owner):
        return None
    if zlib.crc32(data[64:], zlib.crc32(data[:60] + bytes(4))) != crc:
        return None
    payload = data[64:]
    if kind in (DATA, VHDR, TRAILER):
        if paylen > len(payload) or kind == DATA and recoff != NONE and recoff >= paylen:
            return None
        payload = payload[:paylen]
    elif kind in (EDATA, ETRAILER) and paylen > len(payload) - crypto.TAG_BYTES:
        return None
    return Block(kind, blkno, volno, payload, gindex, recoff, flags, prvrecoff, prvpaylen, paylen, version, owner)


@dataclass
class Layout:
    block: int = 65536
    group: int = 10
    parity: int = 1
    volume: int = 0  # bytes; 0: one volume
    codec: int = 0  # 0: not compressed
    solid: bool = False
    keys: crypto.Keys | None = None
    ssuuid: bytes = field(default_factory=lambda: uuid.uuid4().bytes)

    @property
    def version(self) -> int:
        return 3 if self.solid else 2 if self.parity > 1 and self.group else 1

    @property
    def parities(self) -> int:
        return self.parity if self.group else 0

    @property
    def wide(self) -> int:
        """Bytes of a payload that hold records."""
        return self.block - 64 - (crypto.TAG_BYTES if self.keys else 0)

    @property
    def key_tags(self) -> dict:
        k = self.keys
        return {"cipher": crypto.CHACHA20, "kdf": crypto.PBKDF2, "kdfiter": k.rounds, "salt": k.salt, "keycheck": k.check} if k else {}


class Writer:
    """Cuts a record stream into blocks, groups and volumes."""

    def __init__(self, layout: Layout, summary: bytes):
        self.layout, self.summary = layout, summary
        self.volumes: list[list[bytes]] = []
        self.blkno, self.buffer, self.recoff = 0, bytearray(), NONE
        self.group: list[Block] = []
        self.room = layout.volume // layout.block if layout.volume else 1 << 60
        self.new_volume()

    def put(self, kind: int, payload: bytes, **more) -> Block:
        block = Block(kind, self.blkno, len(self.volumes), payload, version=self.layout.version, ssuuid=self.layout.ssuuid, **more)
        self.blkno += 1
        self.volumes[-1].append(block)
        return block

    def locked(self, block: Block) -> Block:
        """An encrypted block: ciphertext, zeros, tag; headers and parity are made over these bytes."""
        layout = self.layout
        block.type, block.paylen = {DATA: EDATA, TRAILER: ETRAILER}[block.type], len(block.payload)
        secret = layout.keys.crypt(block.blkno, block.payload)
        tag = layout.keys.tag(layout.ssuuid, layout.block, block.blkno, block.volno, block.type, block.gindex, block.recoff, secret)
        block.payload = secret.ljust(layout.wide, b"\0") + tag
        return block

    def new_volume(self) -> None:
        self.volumes.append([])
        self.put(VHDR, struct.pack("<HHI", SUMMARY, 0, len(self.summary)) + self.summary)

    def close_block(self) -> None:
        layout = self.layout
        if not self.buffer:
            return
        if not self.group and len(self.volumes[-1]) + 1 + layout.parities > self.room:
            self.new_volume()
        last = self.group[-1] if self.group else None
        block = self.put(DATA, bytes(self.buffer), gindex=len(self.group) if layout.group else 0, recoff=self.recoff, prvrecoff=last.recoff if last else NONE, prvpaylen=last.used if last else 0)
        if layout.keys:
            self.locked(block)
        self.buffer, self.recoff = bytearray(), NONE
        if layout.group:
            self.group.append(block)
            if len(self.group) == layout.group or len(self.volumes[-1]) + 1 + layout.parities > self.room:
                self.close_group()

    def close_group(self) -> None:
        layout, n = self.layout, len(self.group)
        if not n:
            return
        wide = layout.block - 64
        body = np.zeros((n, wide + 8), np.uint8)
        for i, b in enumerate(self.group):
            body[i, : len(b.payload)] = np.frombuffer(b.payload, np.uint8)
            body[i, wide:] = np.frombuffer(struct.pack("<II", b.recoff, b.used), np.uint8)
        last = self.group[-1]
        for j, row in enumerate(galois.parity(body, layout.parity)):
            recoff, paylen = struct.unpack("<II", row[wide:].tobytes()) if layout.parity > 1 else (NONE, wide)
            self.put(PARITY if j else XOR, row[:wide].tobytes(), gindex=n + 256 * j, recoff=recoff, paylen=paylen, prvrecoff=last.recoff, prvpaylen=last.used)
        self.group = []

    def record(self, kind: int, body: bytes) -> tuple[int, int, int]:
        """Appends a record; returns its place (volume, block, offset)."""
        wide = self.layout.wide
        if wide - len(self.buffer) < 8:
            self.close_block()
        if not self.buffer and not self.group and len(self.volumes[-1]) + 1 + self.layout.parities > self.room:
            self.new_volume()
        if self.recoff == NONE:
            self.recoff = len(self.buffer)
        place = (len(self.volumes), self.blkno, len(self.buffer))
        data = struct.pack("<HHI", kind, 0, len(body)) + body
        at = 0
        while at < len(data):
            took = min(wide - len(self.buffer), len(data) - at)
            self.buffer += data[at : at + took]
            at += took
            if len(self.buffer) == wide:
                self.close_block()
        return place

    def finish(self, **totals) -> list[bytes]:
        self.close_block()
        self.close_group()
        if len(self.volumes[-1]) + 1 > self.room:
            self.new_volume()
        trailer = self.put(TRAILER, tlv(nblocks=self.blkno + 1, nvols=len(self.volumes), **totals), flags=LAST_IN_SET)
        if self.layout.keys:
            self.locked(trailer)
        for volume in self.volumes:
            volume[-1].flags |= LAST_IN_VOLUME
        return [b"".join(b.sealed(self.layout.block) for b in volume) for volume in self.volumes]


def regions_of(data: bytes) -> Iterator[tuple[int, int]]:
    """Runs (begin, end) of 64 KiB pieces that are not all zeros."""
    begin = None
    for at in range(0, len(data), PIECE):
        if data.count(0, at, at + PIECE) < min(PIECE, len(data) - at):
            begin = at if begin is None else begin
        elif begin is not None:
            yield begin, at
            begin = None
    if begin is not None:
        yield begin, len(data)


def file_records(fileno: int, attributes: dict, data: bytes | None, codec: int) -> tuple[list[tuple[int, bytes]], int]:
    """FILE, data and FEND records of one file, and the CRC of its data; 64 KiB pieces of zeros are holes."""
    status = attributes.get("status", OK)
    told = {k: v for k, v in attributes.items() if k != "status"}
    out = [(FILE, tlv(fileno=fileno, size=len(data or b""), **told))]
    crc = 0
    for at, end in ((a, min(a + MAX_DATA, end)) for begin, end in regions_of(data or b"") for a in range(begin, end, MAX_DATA)):
        piece = data[at:end]
        crc = zlib.crc32(piece, crc)
        packed = codecs.pack(piece, codec) if codec else None
        if packed is None:
            out.append((DATA_RECORD, struct.pack("<IIQ", fileno, 0, at) + piece))
        else:
            out.append((DATAZ, struct.pack("<IIQI", fileno, codec, at, len(piece)) + packed))
    out.append((FEND, tlv(fileno=fileno, size=len(data or b""), crc=crc, status=status)))
    return out, crc


def write(files: Iterable[tuple[dict, bytes | None]], layout: Layout | None = None, **summary) -> list[bytes]:
    """Volumes of a saveset of (attributes, content) pairs; attributes hold path, ftype, mode, uid, gid, mtime at least.

    A ``status`` of PRESENT makes a catalog entry only, which has a number but no records; other states go into the file's end record.
    """
    layout = layout or Layout()
    summary = {"kind": FULL, **summary}
    head = tlv(product=b"sediment", blocksize=layout.block, groupsize=layout.group, volsize=layout.volume, parity=layout.parity if layout.parity > 1 else None, compress=layout.codec or None, **layout.key_tags, **summary)
    clear = tlv(product=b"sediment", blocksize=layout.block, groupsize=layout.group, volsize=layout.volume, parity=layout.parity if layout.parity > 1 else None, **layout.key_tags) if layout.keys else head
    out = Writer(layout, clear)
    out.record(SUMMARY, head)
    entries, group, nbytes, nsaved = [], [], 0, 0

    def entry(attributes: dict, number: int, size: int, crc: int | None, place, solid: int | None) -> None:
        kept = {k: v for k, v in attributes.items() if k not in ("xattr", "atime", "btime")}
        where = dict(zip(("locvol", "locblk", "locoff"), place or (), strict=False))
        entries.append(tlv(fileno=number, size=size, crc=crc, solid=solid, **where, **{"status": OK, **kept}))

    def flush() -> None:
        if not group:
            return
        raw = b"".join(struct.pack("<HHI", k, 0, len(b)) + b for _, _, _, _, records in group for k, b in records)
        packed = codecs.pack(raw, layout.codec)
        if packed is not None:
            place = out.record(SOLID, struct.pack("<III", layout.codec, len(raw), len(group)) + packed)
            for attributes, number, size, crc, _ in group:
                entry(attributes, number, size, crc, place, 1)
        else:
            for attributes, number, size, crc, records in group:
                places = [out.record(k, b) for k, b in records]
                entry(attributes, number, size, crc, places[0], 0)
        group.clear()

    used = 0
    for number, (attributes, data) in enumerate(files, 1):
        if attributes.get("status") == PRESENT:
            entry({k: v for k, v in attributes.items() if k != "size"}, number, attributes.get("size", 0), None, None, None)
            continue
        nsaved += 1
        member = layout.solid and layout.codec and attributes["ftype"] == REGULAR and len(data or b"") <= MAX_SOLID
        records, crc = file_records(number, attributes, data, 0 if member else layout.codec)
        size = len(data or b"")
        nbytes += size
        if member:
            length = sum(8 + len(b) for _, b in records)
            if group and used + length > MAX_SOLID:
                flush()
                used = 0
            group.append((attributes, number, size, crc, records))
            used += length
        else:
            flush()
            used = 0
            places = [out.record(k, b) for k, b in records]
            entry(attributes, number, size, crc, places[0], None)
    flush()
    batch, first = [], None
    for item in [*entries, None]:
        if batch and (item is None or sum(map(len, batch)) + len(item) + 4 > MAX_DATA):
            place = out.record(CATALOG, b"".join(batch))
            first = first or place
            batch = []
        if item is not None:
            batch.append(struct.pack("<I", len(item)) + item)
    totals = {"nfiles": nsaved, "nbytes": nbytes, "nerrors": 0}
    out.record(END, tlv(**totals))
    where = dict(zip(("catvol", "catblk", "catoff"), first, strict=True)) if first else {}
    return out.finish(nentries=len(entries), **totals, **where)


def summary_of(volume: bytes) -> tuple[int, dict] | None:
    """(block size, summary) from a volume's header block, or null if this is no volume."""
    if len(volume) < 64 or volume[:4] != MAGIC:
        return None
    size = struct.unpack("<I", volume[8:12])[0]
    head = opened(volume[:size], size)
    if head is None or head.type != VHDR:
        return None
    return size, tlv_items(head.payload[8:])


def guessed_size(volume: bytes) -> int | None:
    """Block size when the first block is lost: the least size at which another header stands."""
    for size in range(8192, (1 << 20) + 1, 512):
        if volume[size : size + 4] == MAGIC and volume[size + 8 : size + 12] == struct.pack("<I", size):
            return size
    return None


def unlocked(block: Block | None, size: int, keys: crypto.Keys | None) -> bytes | None:
    """Plaintext of an encrypted block whose tag is right, else null."""
    secret, tag = block.payload[: block.paylen], block.payload[-crypto.TAG_BYTES :]
    right = keys.tag(block.ssuuid, size, block.blkno, block.volno, block.type, block.gindex, block.recoff, secret)
    return keys.crypt(block.blkno, secret) if crypto.hmac.compare_digest(tag, right) else None


def shape_of(volumes: list, passphrase: bytes | None, label: str) -> tuple[int, int, int, crypto.Keys | None]:
    """(block size, data blocks of a group, parity blocks, keys) of a saveset."""
    known = next((s for s in map(summary_of, volumes) if s), None)
    if known is None:
        size = next((s for s in map(guessed_size, volumes) if s), None)
        if size is None:
            raise ValueError("no volume of a saveset")
        group, parity = 0, 1
        for v in volumes:
            for a in range(0, len(v), size):
                b = opened(v[a : a + size], size)
                if b and b.type == XOR:
                    group = group or b.gindex & 255
                elif b and b.type == PARITY:
                    parity = max(parity, (b.gindex >> 8) + 1)
        return size, group, parity, None
    size, summary = known
    if "cipher" not in summary:
        return size, summary.get("groupsize", 10), summary.get("parity", 1), None
    if passphrase is None or summary["cipher"] != crypto.CHACHA20 or summary["kdf"] != crypto.PBKDF2:
        raise ValueError("the saveset is encrypted")
    keys = crypto.Keys.derive(passphrase, summary["salt"], summary["kdfiter"], label)
    if keys.check != summary["keycheck"]:
        raise ValueError("wrong passphrase")
    return size, summary.get("groupsize", 10), summary.get("parity", 1), keys


def trailer_of(volumes: list, passphrase: bytes | None = None, label: str = "SEDIMENT") -> dict | None:
    """Items of the trailer, from the last block of the last volume alone; null if it is lost."""
    size, _, _, keys = shape_of(volumes, passphrase, label)
    last = volumes[-1]
    block = opened(last[len(last) - size :], size)
    if block is None or block.type not in (TRAILER, ETRAILER):
        return None
    plain = unlocked(block, size, keys) if block.type == ETRAILER else block.payload
    return None if plain is None else tlv_items(plain)


def groups_of(volumes: list, events: list[tuple], passphrase: bytes | None = None, label: str = "SEDIMENT", start: tuple[int, int] | None = None) -> Iterator[Block | int]:
    """Data blocks in order, repaired where the parity allows, decrypted last; the number of blocks for a loss.

    Volumes are bytes or :class:`Volume`; one group is in memory at a time. ``start`` (volume, number of a block): only
    the group of that block and what follows is read.
    """
    size, group, parity, keys = shape_of(volumes, passphrase, label)
    wide = size - 64
    kind = EDATA if keys else DATA
    span = group + parity if group else 1

    def good(block: Block | None) -> Block | None:
        """Null for a block of another saveset's kind or with a wrong tag."""
        if block is not None and keys and block.type in (EDATA, ETRAILER) and unlocked(block, size, keys) is None:
            return None
        return block

    def plain(block: Block) -> Block:
        if keys:
            block.payload = unlocked(block, size, keys)
        return block

    def blocks_at(volume, first: int, n: int) -> list[Block | None]:
        data = volume[(1 + first) * size : (1 + first + n) * size]
        return [good(opened(data[i * size : (i + 1) * size], size)) for i in range(n)]

    for k, volume in enumerate(volumes, 1):
        head = opened(volume[:size], size)
        number = k if head is None else head.volno  # a volume may be missing
        if start and number < start[0]:
            continue
        n_blocks = max(0, -(-len(volume) // size) - 1)
        if n_blocks:
            (end,) = blocks_at(volume, n_blocks - 1, 1)
            if end is None and k == len(volumes) or end is not None and end.type in (TRAILER, ETRAILER):
                n_blocks -= 1
        begin = 0
        if start and number == start[0]:
            if head is not None:  # blocks are numbered on from the volume's header
                begin = max(0, start[1] - head.blkno - 1) // span * span
        for at in range(begin, n_blocks, span):
            blocks = blocks_at(volume, at, min(span, n_blocks - at))
            if not group:
                yield from (plain(b) if b is not None else 1 for b in blocks if b is None or b.type == kind)
                continue
            n = len(blocks) - parity
            tail = next((b for b in blocks if b is not None and b.type in (XOR, PARITY)), None)
            if tail is not None:
                n = min(n, tail.gindex & 255)
            data, rows = blocks[:n], {b.gindex >> 8: b for b in blocks[n:] if b is not None and b.type in (XOR, PARITY)}
            lost = [i for i, b in enumerate(data) if b is None or b.type != kind]
            if lost and len(lost) <= len(rows):
                fixed = repaired(data, lost, rows, wide, parity, kind)
                if fixed is None or any(good(b) is None for b in fixed.values()):
                    events.append(("PARITY", number, at + 1))
                else:
                    for i, b in fixed.items():
                        data[i] = b
                        events.append(("REPAIRED", number, at + 1 + i))
                    lost = []
            for i, b in enumerate(data):
                if i in lost:
                    events.append(("LOST", number, at + 1 + i))
                    yield 1
                else:
                    yield plain(b)


def repaired(data: list, lost: list[int], rows: dict[int, Block], wide: int, parity: int, kind: int) -> dict[int, Block] | None:
    """Lost blocks of a group, or null if what comes out is not right."""
    n = len(data)
    body = np.zeros((n, wide + 8), np.uint8)
    for i, b in enumerate(data):
        if i not in lost:
            body[i, : len(b.payload)] = np.frombuffer(b.payload, np.uint8)
            body[i, wide:] = np.frombuffer(struct.pack("<II", b.recoff, b.used), np.uint8)
    told = {j: np.concatenate([np.frombuffer(b.payload, np.uint8), np.frombuffer(struct.pack("<II", b.recoff, b.paylen) if parity > 1 else bytes(8), np.uint8)]) for j, b in rows.items()}
    body[lost] = galois.solve(body, lost, told)
    for j, row in told.items():
        check = np.zeros(wide, np.uint8)
        for i in range(n):
            check ^= galois.times(galois.coefficient(j, i), body[i, :wide])
        if not np.array_equal(check, row[:wide]):
            return None
    out = {}
    some = next(iter(rows.values()))
    for i in lost:
        if parity > 1:
            recoff, paylen = struct.unpack("<II", body[i, wide:].tobytes())
        else:
            after = data[i + 1] if i + 1 < n else rows[0]
            recoff, paylen = after.prvrecoff, after.prvpaylen
        if paylen > wide or recoff != NONE and recoff >= paylen:
            return None
        kept = paylen if kind == DATA else wide
        out[i] = Block(kind, some.blkno - (some.gindex >> 8) - n + i, some.volno, body[i, :kept].tobytes(), i, recoff, paylen=paylen, version=some.version, ssuuid=some.ssuuid)
    return out


def records_of(volumes: list, events: list[tuple], passphrase: bytes | None = None, label: str = "SEDIMENT", start: tuple[int, int, int] | None = None) -> Iterator[tuple]:
    """(type, body, volume, block, offset, resync, in solid) of every record that is whole.

    ``start`` (volume, block, offset): from the record there on; nothing if its block is lost.
    """
    sought = start
    parts: list[bytes] = []
    have, need, place, resync, skipping = 0, 0, None, False, False
    head = b""
    for block in groups_of(volumes, events, passphrase, label, start[:2] if start else None):
        if sought and (isinstance(block, int) or block.blkno < sought[1]):
            continue
        if isinstance(block, int):
            parts, have, need, head, skipping = [], 0, 0, b"", True
            continue
        at = 0
        if sought:
            if block.blkno > sought[1]:
                return
            at, sought = sought[2], None
        if skipping:
            if block.recoff == NONE:
                continue
            at, skipping, resync = block.recoff, False, True
        while at < len(block.payload):
            if not need:
                if len(block.payload) - at < 8:
                    break
                head = block.payload[at : at + 8]
                place = (block.volno, block.blkno, at)
                need = struct.unpack("<HHI", head)[2]
                kind = struct.unpack("<H", head[:2])[0]
                if not kind or need > MAX_RECORD:
                    events.append(("BADREC", block.volno, block.blkno))
                    need, skipping = 0, True
                    break
                at, parts, have = at + 8, [], 0
                need = need or -1
            took = block.payload[at : at + max(need, 0) - have]
            parts.append(took)
            have += len(took)
            at += len(took)
            if have >= max(need, 0):
                kind, body = struct.unpack("<H", head[:2])[0], b"".join(parts)
                need = 0
                if kind == SOLID and block.version == 3:
                    yield from members(body, place, resync, events)
                else:
                    yield kind, body, *place, resync, False
                resync = False


def members(body: bytes, start: tuple, resync: bool, events: list[tuple]) -> Iterator[tuple]:
    """Records inside a SOLID; of a stream that does not open, those of its correct prefix."""
    codec, size, _ = struct.unpack_from("<III", body)
    if not 8 <= size <= MAX_SOLID_RAW:
        events.append(("BADREC", *start[:2]))
        return
    try:
        raw = codecs.decode(body[12:], codec, size)
    except ValueError:
        events.append(("BADREC", *start[:2]))
        try:
            raw = codecs.decode(body[12:], codec, size, partial=True)
        except ValueError:
            return
    at = 0
    while at + 8 <= len(raw):
        kind, _, n = struct.unpack_from("<HHI", raw, at)
        if kind not in (FILE, DATA_RECORD, FEND) or at + 8 + n > len(raw):
            break
        yield kind, raw[at + 8 : at + 8 + n], *start, resync, True
        at, resync = at + 8 + n, False


def data_of(kind: int, body: bytes) -> tuple[int, int, bytes]:
    """(fileno, offset, bytes) of a DATA or DATAZ record."""
    if kind == DATA_RECORD:
        fileno, _, at = struct.unpack_from("<IIQ", body)
        return fileno, at, body[16:]
    fileno, codec, at, size = struct.unpack_from("<IIQI", body)
    return fileno, at, codecs.decode(body[20:], codec, size)


def files_of(volumes: list, events: list[tuple], passphrase: bytes | None = None, label: str = "SEDIMENT", start: tuple[int, int, int] | None = None) -> Iterator[dict]:
    """Whole files: attributes, content, and whether size and CRC are right; from the record at ``start`` on."""
    now: dict | None = None
    for kind, body, *_, resync, _ in records_of(volumes, events, passphrase, label, start):
        if kind == FILE:
            now = {**tlv_items(body), "parts": []}
        elif now and kind in (DATA_RECORD, DATAZ):
            try:
                fileno, at, data = data_of(kind, body)
            except ValueError:
                continue
            if fileno == now["fileno"]:
                now["parts"].append((at, data))
        elif now and kind == FEND:
            end = tlv_items(body)
            if end["fileno"] == now["fileno"]:
                content, crc = bytearray(end["size"]), 0
                for at, data in now["parts"]:
                    content[at : at + len(data)] = data
                    crc = zlib.crc32(data, crc)
                yield {**now, "content": bytes(content), "crc": end["crc"], "status": end["status"], "intact": crc == end["crc"]}
            now = None


def catalog_of(volumes: list, events: list[tuple], passphrase: bytes | None = None, label: str = "SEDIMENT", seek: bool = True) -> Iterator[dict]:
    """Catalog entries; with ``seek`` from the place the trailer tells, else (or without a trailer) out of the whole stream."""
    trailer = trailer_of(volumes, passphrase, label) if seek else None
    place = tuple(trailer[k] for k in ("catvol", "catblk", "catoff")) if trailer and "catvol" in trailer else None
    found = 0
    for kind, body, *_ in records_of(volumes, events, passphrase, label, place):
        if place and kind == END:
            break
        at = 0
        while kind == CATALOG and at + 4 <= len(body):
            (n,) = struct.unpack_from("<I", body, at)
            found += 1
            yield tlv_items(body[at + 4 : at + 4 + n])
            at += 4 + n
    if place and not found:
        yield from catalog_of(volumes, events, passphrase, label, seek=False)


def file_named(volumes: list, path: bytes, events: list[tuple], passphrase: bytes | None = None, label: str = "SEDIMENT") -> Iterator[dict]:
    """Files saved under a name: read from where the catalog says they begin, not from the start of the saveset."""
    for entry in catalog_of(volumes, events, passphrase, label):
        if entry["path"] != path or entry.get("status") == PRESENT or "locblk" not in entry:
            continue
        place = (entry["locvol"], entry["locblk"], entry["locoff"])
        for file in files_of(volumes, events, passphrase, label, place):
            if file["fileno"] == entry["fileno"]:
                yield file
            if file["fileno"] >= entry["fileno"]:
                break
