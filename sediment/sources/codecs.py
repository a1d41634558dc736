"""Codecs of compressed data records. Every decoder can return the correct prefix of a cut stream."""

from __future__ import annotations

import lzma
import zlib

#: Fixed values of the format.
LZ4, DEFLATE, LZMA = 1, 2, 3
LZMA_FILTER = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}]


def lz4_decode(data: bytes, size: int, partial: bool = False) -> bytes:
    """An LZ4 block of ``size`` decoded bytes."""
    out, at = bytearray(), 0

    def length(base: int) -> int:
        nonlocal at
        if base == 15:
            while True:
                more = data[at]
                at += 1
                base += more
                if more != 255:
                    break
        return base

    try:
        while at < len(data) and len(out) < size:
            token = data[at]
            at += 1
            n = length(token >> 4)
            if at + n > len(data):
                raise ValueError("literals run out")
            out += data[at : at + n]
            at += n
            if at >= len(data):
                break
            back = data[at] | data[at + 1] << 8
            at += 2
            n = length(token & 15) + 4
            if not 0 < back <= len(out):
                raise ValueError("match before the start")
            for _ in range(n) if back < n else ():
                out.append(out[-back])
            if back >= n:
                out += out[-back : len(out) - back + n] if back > n else out[-back:]
    except (IndexError, ValueError):
        if not partial:
            raise ValueError("bad LZ4 block") from None
    if not partial and len(out) != size:
        raise ValueError("bad LZ4 length")
    return bytes(out[:size])


def lz4_encode(data: bytes) -> bytes:
    """An LZ4 block by greedy matches of four bytes (the last five bytes are literals)."""
    out, table, anchor, i, end = bytearray(), {}, 0, 0, len(data) - 12

    def put(literals: bytes, back: int, n: int) -> None:
        lit, match = len(literals), n - 4
        out.append(min(lit, 15) << 4 | (min(match, 15) if back else 0))
        for value in (lit,):
            if value >= 15:
                out.extend([255] * ((value - 15) // 255) + [(value - 15) % 255])
        out.extend(literals)
        if back:
            out.extend((back & 255, back >> 8))
            if match >= 15:
                out.extend([255] * ((match - 15) // 255) + [(match - 15) % 255])

    while i < end:
        key = data[i : i + 4]
        seen = table.get(key)
        table[key] = i
        if seen is None or i - seen > 65535:
            i += 1
            continue
        n = 4
        while i + n < len(data) - 5 and data[seen + n] == data[i + n]:
            n += 1
        put(data[anchor:i], i - seen, n)
        i += n
        anchor = i
    put(data[anchor:], 0, 4)
    return bytes(out)


def encode(data: bytes, codec: int, level: int = 5) -> bytes:
    if codec == LZ4:
        return lz4_encode(data)
    if codec == DEFLATE:
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        return packer.compress(data) + packer.flush()
    if codec == LZMA:
        return lzma.compress(data, lzma.FORMAT_RAW, filters=LZMA_FILTER)
    raise ValueError(f"unknown codec {codec}")


def decode(data: bytes, codec: int, size: int, partial: bool = False) -> bytes:
    """Decoded bytes; with ``partial`` the correct prefix of a stream that is cut."""
    if codec == LZ4:
        return lz4_decode(data, size, partial)
    if codec not in (DEFLATE, LZMA):
        raise ValueError(f"unknown codec {codec}")
    unpacker = zlib.decompressobj(-15) if codec == DEFLATE else lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=LZMA_FILTER)
    out = bytearray()
    try:
        step = 1 if partial else max(1, len(data))
        for at in range(0, len(data), step):
            out += unpacker.decompress(data[at : at + step])
    except (zlib.error, lzma.LZMAError, EOFError):
        if not partial:
            raise ValueError("bad compressed stream") from None
    if not partial and len(out) != size:
        raise ValueError("bad decoded length")
    return bytes(out[:size])


#: Octets of a long piece that the fast codec tries first, and the share of them above which it gives up.
PROBE, PROBE_SHARE = 1 << 16, 0.97


def pack(data: bytes, codec: int, level: int = 5) -> bytes | None:
    """Compressed bytes if they are shorter by more than four and decode to the same, else null."""
    if codec == LZ4 and len(data) >= 2 * PROBE and len(lz4_encode(data[:PROBE])) > PROBE_SHARE * PROBE:
        return None
    packed = encode(data, codec, level)
    return packed if len(packed) + 4 < len(data) and decode(packed, codec, len(data)) == data else None
