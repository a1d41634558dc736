"""CRC-32 of pieces put together: the CRC of a whole is the XOR of its pieces' CRCs, each shifted past what follows it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reflected polynomial of CRC-32/IEEE.
POLYNOMIAL = 0xEDB88320


def times_matrix(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), as the images of the single bits, times each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def zero_matrices(count: int) -> list[np.ndarray]:
    """What 2^k zero octets do to a CRC, for k under ``count``."""
    one_bit = np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint32)
    matrix = one_bit
    for _ in range(3):
        matrix = times_matrix(matrix, matrix)
    out = []
    for _ in range(count):
        out.append(matrix)
        matrix = times_matrix(matrix, matrix)
    return out


MATRICES = zero_matrices(48)


def shifted(crc: np.ndarray, octets: np.ndarray) -> np.ndarray:
    """CRCs moved past numbers of octets that follow."""
    out = crc.astype(np.uint32)
    for k in range(int(octets.max(initial=0)).bit_length()):
        on = (octets >> k) & 1 == 1
        out[on] = times_matrix(MATRICES[k], out[on])
    return out


def shift_column(crc: Column, octets: Column) -> Column:
    @F.pandas_udf("long")
    def move(c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(shifted(c.to_numpy().astype(np.uint32), n.to_numpy()).astype(np.int64))

    return move(crc, octets)


def combined(pieces: DataFrame, key: str, crc: str, after: str) -> DataFrame:
    """(key, crc) of whole files from their pieces' CRCs and the octets after each piece; XOR combines before the shuffle, in any order."""
    return pieces.select(key, shift_column(F.col(crc), F.col(after)).alias("_crc")).groupBy(key).agg(F.bit_xor("_crc").alias("crc"))
