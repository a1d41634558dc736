"""GF(256) sums over blocks and the solution for lost blocks."""

from __future__ import annotations

import numpy as np

from sediment.operators.packing import coefficient, gf_tables

_EXP, _LOG = gf_tables()
_TABLE = np.zeros((256, 256), np.uint8)
for _a in range(1, 256):
    _TABLE[_a, 1:] = _EXP[_LOG[_a] + _LOG[1:256]]


def times(factor: int, data: np.ndarray) -> np.ndarray:
    return _TABLE[factor][data]


def inverse(a: int) -> int:
    return int(_EXP[255 - _LOG[a]])


def parity(blocks: np.ndarray, rows: int) -> np.ndarray:
    """Parity rows of data blocks (n x bytes)."""
    out = np.zeros((rows, blocks.shape[1]), np.uint8)
    for j in range(rows):
        for i, block in enumerate(blocks):
            out[j] ^= times(coefficient(j, i), block)
    return out


def solve(blocks: np.ndarray, lost: list[int], parities: dict[int, np.ndarray]) -> np.ndarray:
    """Lost blocks from the good ones and as many parity rows. ``blocks`` has anything in the lost places."""
    rows = sorted(parities)[: len(lost)]
    right = []
    for j in rows:
        rest = parities[j].copy()
        for i, block in enumerate(blocks):
            if i not in lost:
                rest ^= times(coefficient(j, i), block)
        right.append(rest)
    matrix = [[coefficient(j, i) for i in lost] for j in rows]
    for c in range(len(lost)):
        pivot = next(r for r in range(c, len(rows)) if matrix[r][c])
        matrix[c], matrix[pivot], right[c], right[pivot] = matrix[pivot], matrix[c], right[pivot], right[c]
        scale = inverse(matrix[c][c])
        matrix[c] = [int(_TABLE[scale, x]) for x in matrix[c]]
        right[c] = times(scale, right[c])
        for r in range(len(rows)):
            if r != c and matrix[r][c]:
                factor = matrix[r][c]
                matrix[r] = [x ^ int(_TABLE[factor, y]) for x, y in zip(matrix[r], matrix[c], strict=True)]
                right[r] = right[r] ^ times(factor, right[c])
    return np.array(right)
