"""Blocks, groups, volumes, packing and parity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sediment.storage import materialize

POLYNOMIAL = 0x11D
SOLID_BYTES = 262_144


#: monotonically_increasing_id: the partition is above these bits, the place in it below.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list, name: str = "blkno", start: int = 0) -> DataFrame:
    """Dense numbers in a total order without one task for all rows.

    Range partitions are sorted and written once with each row's place; counts and rows are both
    read from that table, so they can't be dealt out in two ways. Each partition adds the rows of those before it. ``order`` has to
    tell all rows apart, or numbers among equals are arbitrary. Nulls come first. An empty table gives no rows.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    parts = materialize(placed, "numbered").withColumns({"_p": F.shiftright("_m", PLACE_BITS), "_i": F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a partition
    return parts.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + start).drop("_p", "_m", "_i", "_before")


def group_of(position: Column, group: int, parity: int) -> tuple[Column, Column]:
    """(group number, index in the group) of a block position; a group has data and parity blocks."""
    return F.floor(position / (group + parity)).cast("long"), F.pmod(position, F.lit(group + parity)).cast("int")


def volume_room(blocks: int, group: int, parity: int) -> int:
    """Data blocks of a full volume of ``blocks``: a header, whole groups, and a last group for which its parity blocks are kept free."""
    whole, rest = divmod(blocks - 1, group + parity)
    return whole * group + max(0, rest - parity)


def volume_of(number: Column, blocks: int, group: int, parity: int) -> tuple[Column, Column]:
    """(volume, place among its blocks) of a data block by its number among data blocks; volumes count from 1, the header has place 0."""
    room = volume_room(blocks, group, parity)
    within = F.pmod(number, F.lit(room))
    return (F.floor(number / room) + 1).cast("long"), (1 + within + F.floor(within / group) * parity).cast("long")


def volume_totals(count: int, blocks: int, group: int, parity: int) -> tuple[int, int]:
    """(volumes, blocks in all) of a set of ``count`` data blocks: headers, parity and the trailer, which opens a volume if the last one is full."""
    room = volume_room(blocks, group, parity)
    full, rest = divmod(count, room)
    if count and not rest:
        full, rest = full - 1, room
    used = 1 + rest + -(-rest // group) * parity
    volumes, total = full + 1, full * (1 + room + -(-room // group) * parity) + used
    return (volumes + 1, total + 2) if used + 1 > blocks else (volumes, total + 1)


def previous_fields(rows: DataFrame, group: str, index: str, fields: dict[str, object]) -> DataFrame:
    """Adds prv_<field> of the previous row of the group, or the given value."""
    w = Window.partitionBy(group).orderBy(index)
    return rows.withColumns({f"prv_{c}": F.lag(c, 1, default).over(w) for c, default in fields.items()})


def rebuilt_fields(rows: DataFrame, group: str, index: str, fields: list[str]) -> DataFrame:
    """Fields of each row as the next row of the group tells them (null for the last)."""
    w = Window.partitionBy(group).orderBy(index)
    return rows.withColumns({f"re_{c}": F.lead(f"prv_{c}").over(w) for c in fields})


def packed(rows: DataFrame, keys: list[str], order: str, size: str, cap: int = SOLID_BYTES) -> DataFrame:
    """Sequential packing within each key: a bin closes before a row that would pass ``cap``. Adds ``bin``."""
    schema = StructType([*rows.schema.fields, StructField("bin", LongType())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        bins, used, now = [], 0, 0
        for n in table[size].to_pylist():
            if used and used + n > cap:
                now, used = now + 1, 0
            used += n
            bins.append(now)
        return table.append_column("bin", pa.array(bins, pa.int64()))

    return rows.groupBy(*keys).applyInArrow(pack, schema)


def xor_parity(rows: DataFrame, group: str, lanes: list[str]) -> DataFrame:
    """XOR of integer lanes of each group: associative, so it combines before the shuffle."""
    return rows.groupBy(group).agg(*(F.bit_xor(c).alias(c) for c in lanes))


def gf_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of 2 in GF(256)."""
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = (x << 1) ^ (POLYNOMIAL if x & 0x80 else 0)
    return exp, log


def gf_mul(a: int, b: int) -> int:
    exp, log = gf_tables()
    return int(exp[log[a] + log[b]]) if a and b else 0


def coefficient(row: int, block: int) -> int:
    """Factor of data block ``block`` in parity row ``row``: a scaled Cauchy matrix, ones in row 0."""
    exp, log = gf_tables()
    y = 128 + block
    return int(exp[log[y] - log[row ^ y] + 255])


def parity_rows(rows: DataFrame, group: str, index: str, lanes: list[str], parity: int, most: int = 100) -> DataFrame:
    """Parity rows 0 to parity - 1 of each group: GF(256) sums over its rows, combined before the shuffle.

    ``lanes`` are byte-valued columns; ``index`` is the row's place in its group, under ``most``.
    """
    exp, log = gf_tables()
    exps = F.array(*(F.lit(int(x)) for x in exp))
    logs = F.array(*(F.lit(int(x)) for x in log))
    factor_logs = F.array(*(F.array(*(F.lit(int(log[coefficient(j, i)])) for i in range(most))) for j in range(parity)))
    wide = rows.select(group, index, *lanes, F.explode(F.sequence(F.lit(0), F.lit(parity - 1))).alias("row"))
    shift = F.get(F.get(factor_logs, F.col("row")), F.col(index))

    def times(c: str) -> Column:
        return F.when(F.col(c) == 0, 0).otherwise(F.get(exps, F.get(logs, F.col(c).cast("int")) + shift))

    return wide.groupBy(group, "row").agg(*(F.bit_xor(times(c)).alias(c) for c in lanes))
