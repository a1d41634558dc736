"""Kernels of the saveset format: layouts, repair, loss, codecs and salvage."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from sediment.sources import blocks, codecs, crypto, galois


def tree(n=60, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        size = rng.choice([0, 1, 100, 5000, 8191, 8192, 30000])
        data = (b"some text %d " % i) * (size // 12 + 1) if i % 3 else rng.randbytes(size)
        yield {"path": b"d%02d/f%d" % (i % 7, i), "ftype": 1, "mode": 0o644, "uid": 1, "gid": 1, "mtime": (i, 5)}, data[:size]


LAYOUTS = [
    blocks.Layout(block=8192, group=4),
    blocks.Layout(block=8192, group=3, volume=8192 * 12),
    blocks.Layout(block=8192, group=0, volume=8192 * 10),
    blocks.Layout(block=8192, group=5, parity=3, codec=codecs.DEFLATE),
    blocks.Layout(block=8192, group=5, codec=codecs.LZMA, solid=True),
    blocks.Layout(block=8192, group=5, codec=codecs.LZ4, solid=True),
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_roundtrip(layout):
    files = list(tree())
    volumes, events = blocks.write(iter(files), layout), []
    got = list(blocks.files_of(volumes, events))
    assert [(g["path"], g["content"]) for g in got] == [(a["path"], d) for a, d in files]
    assert all(g["intact"] for g in got) and not events
    assert [e["path"] for e in blocks.catalog_of(volumes, events)] == [a["path"] for a, _ in files]
    if layout.volume:
        assert len(volumes) > 1 and all(len(v) <= layout.volume for v in volumes)


@pytest.mark.parametrize("layout", [LAYOUTS[0], LAYOUTS[3]])
def test_repair_and_loss(layout):
    files = list(tree())
    (volume,), span = blocks.write(iter(files), layout), layout.group + layout.parity
    for lost in range(1, layout.parity + 2):
        bad = bytearray(volume)
        for i in range(lost):
            at = (1 + span + i) * layout.block
            bad[at + 70 : at + 90] = os.urandom(20)
        events: list = []
        got = {g["path"]: g for g in blocks.files_of([bytes(bad)], events)}
        if lost <= layout.parity:
            assert {p: g["content"] for p, g in got.items()} == {a["path"]: d for a, d in files}
            assert {e[0] for e in events} <= {"REPAIRED"}
        else:  # nothing silent: what is delivered as intact is right
            assert {e[0] for e in events} == {"LOST"}
            assert all(g["content"] == dict((a["path"], d) for a, d in files)[p] for p, g in got.items() if g["intact"])
            assert len(got) < len(files) or not all(g["intact"] for g in got.values())


def test_every_erasure_of_small_groups():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 2), (5, 3), (6, 4)):
        data = rng.integers(0, 256, (n, 16), dtype=np.uint8)
        rows = galois.parity(data, m)
        for e in range(1, min(n, m) + 1):
            for lost in itertools.combinations(range(n), e):
                for kept in itertools.combinations(range(m), e):
                    hurt = data.copy()
                    hurt[list(lost)] = 0
                    assert np.array_equal(galois.solve(hurt, list(lost), {j: rows[j] for j in kept}), data[list(lost)])


@pytest.mark.parametrize("codec", [codecs.LZ4, codecs.DEFLATE, codecs.LZMA])
def test_codecs_and_prefixes(codec):
    data = b"".join(b"line %d of a text that repeats itself\n" % (i % 50) for i in range(400)) + b"a" * 300 + os.urandom(200)
    packed = codecs.encode(data, codec)
    assert codecs.decode(packed, codec, len(data)) == data
    for cut in range(0, len(packed), 97):
        assert data.startswith(codecs.decode(packed[:cut], codec, len(data), partial=True))


def test_known_values():
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert all(galois.coefficient(0, i) == 1 for i in range(100))
    with pytest.raises(ValueError):
        blocks.tlv_items(b"\x01\x00\xff\x00\x00\x00x")
    assert blocks.tlv_items(blocks.tlv(fileno=7, path=b"x"))["fileno"] == 7
    assert blocks.tlv_items(b"\xfe\x00\x01\x00\x00\x00z")["extra"] == {254: b"z"}


def test_cipher_vectors():
    key, nonce = bytes(range(32)), bytes.fromhex("000000000000004a00000000")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    assert crypto.chacha20(key, nonce, text, 1)[:16].hex() == "6e2e359a2568f98041ba0728dd0d6981"
    assert crypto.hmac_sha256(b"Jefe", b"what do ya want for nothing?").hex().startswith("5bdcc146bf60754e6a042426089575c7")


@pytest.mark.parametrize("parity", [1, 2])
def test_encrypted(parity):
    files = list(tree())
    keys = crypto.Keys.derive(b"secret words", rounds=1000)
    layout = blocks.Layout(block=8192, group=4, parity=parity, codec=codecs.DEFLATE, keys=keys)
    (volume,) = blocks.write(iter(files), layout)
    bad = bytearray(volume)
    for i in range(parity):
        bad[(1 + i) * 8192 + 100] ^= 1
    for data in (volume, bytes(bad)):
        got = list(blocks.files_of([data], [], b"secret words"))
        assert [(g["path"], g["content"]) for g in got] == [(a["path"], d) for a, d in files]
    assert b"some text" not in volume
    with pytest.raises(ValueError, match="wrong passphrase"):
        list(blocks.files_of([volume], [], b"other"))
    forged = bytearray(volume)  # a right checksum over other bytes: the tag finds it
    forged[8192 + 100] ^= 1
    head = bytes(forged[8192 : 8192 + 60]) + bytes(4)
    forged[8192 + 60 : 8192 + 64] = zlib.crc32(bytes(forged[8192 + 64 : 16384]), zlib.crc32(head)).to_bytes(4, "little")
    events: list = []
    assert len(list(blocks.files_of([bytes(forged)], events, b"secret words"))) == len(files) and {e[0] for e in events} == {"REPAIRED"}
