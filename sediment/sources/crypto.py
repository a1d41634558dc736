"""Keys, stream cipher and tags of encrypted blocks."""

from __future__ import annotations

import hashlib
import hmac
import os
import struct
from dataclasses import dataclass

import numpy as np

#: Algorithm numbers, size of a tag.
CHACHA20, PBKDF2 = 1, 1
TAG_BYTES = 32


def hmac_sha256(key: bytes, data: bytes) -> bytes:
    return hmac.new(key, data, hashlib.sha256).digest()


def chacha20(key: bytes, nonce: bytes, data: bytes, counter: int = 0) -> bytes:
    """ChaCha20 of RFC 8439, all 64-byte blocks at once."""
    n = -(-len(data) // 64)
    if not n:
        return b""
    state = np.empty((16, n), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(counter, counter + n, dtype=np.uint32)
    state[13:] = np.frombuffer(nonce, "<u4")[:, None]
    x = state.copy()

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for into, by, turned, shift in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[into] += x[by]
            t = x[turned] ^ x[into]
            x[turned] = t << np.uint32(shift) | t >> np.uint32(32 - shift)

    for _ in range(10):
        for i in range(4):
            quarter(i, 4 + i, 8 + i, 12 + i)
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
    stream = (x + state).T.astype("<u4").tobytes()
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8)[: len(data)]).tobytes()


@dataclass(frozen=True)
class Keys:
    """Keys of one saveset. ``label`` is the word before ENC, MAC and CHECK in the key labels of the writing program."""

    enc: bytes
    mac: bytes
    check: bytes
    salt: bytes
    rounds: int

    @staticmethod
    def derive(passphrase: bytes, salt: bytes | None = None, rounds: int = 600_000, label: str = "SEDIMENT") -> Keys:
        salt = salt if salt is not None else os.urandom(32)
        if rounds < 1000:
            raise ValueError("at least 1000 iterations")
        master = hashlib.pbkdf2_hmac("sha256", passphrase, salt, rounds, 32)
        return Keys(*(hmac_sha256(master, f"{label} {word}".encode()) for word in ("ENC", "MAC", "CHECK")), salt, rounds)

    def crypt(self, blkno: int, data: bytes) -> bytes:
        return chacha20(self.enc, struct.pack("<IQ", 0, blkno), data)

    def tag(self, ssuuid: bytes, bsize: int, blkno: int, volno: int, kind: int, gindex: int, recoff: int, ciphertext: bytes) -> bytes:
        return hmac_sha256(self.mac, ssuuid + struct.pack("<IQIBHII", bsize, blkno, volno, kind, gindex, recoff, len(ciphertext)) + ciphertext)


def passphrase_in(path: str) -> bytes:
    """The first line of a key file, which nobody but its owner may read."""
    import os

    with open(path, "rb") as file:
        if os.fstat(file.fileno()).st_mode & 0o077:
            raise PermissionError(f"{path}: others can read the key file")
        line = file.readline().rstrip(b"\r\n")
    if not line:
        raise ValueError(f"{path}: no passphrase in the key file")
    return line
