"""Literals, names, times and modes of catalog entries as column expressions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types, permission letters, attribute words.
TYPE_LETTERS = ["?", "-", "d", "l", "-", "c", "b", "p", "s"]
WINDOWS_WORDS = [(1, "READONLY"), (2, "HIDDEN"), (4, "SYSTEM"), (32, "ARCHIVE")]
#: 100 ns units from 17-NOV-1858 to 1970.
EPOCH_1858 = 35_067_168_000_000_000
RECORD_FORMATS = ["undefined", "fixed", "variable", "vfc", "stream", "stream_lf", "stream_cr"]


def little_endian(data: Column, at: int, size: int) -> Column:
    """Unsigned integer of 1, 2, 4 or 8 bytes at an offset, as a long."""
    return F.conv(F.hex(F.reverse(F.substring(data, at + 1, size))), 16, 10).cast("long" if size < 8 else "decimal(20,0)")


def size_literal(text: Column) -> Column:
    """Bytes of a size such as 64K, 1M or 2GB; null if it is none."""
    number = F.regexp_extract(text, r"^(\d+)([KMGT]?)B?$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([KMGT]?)B?$", 2)
    times = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)
    return F.when(number != "", number.cast("long") * times.cast("long"))


def volume_name(spec: Column, number: Column) -> Column:
    """Name of a volume: the first bears the plain name, others a number of three digits at least."""
    padded = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return F.when(number == 1, spec).otherwise(F.concat(spec, F.lit("."), padded))


def permissions(mode: Column) -> Column:
    """Nine permission letters with the set-id and sticky marks."""
    def bit(mask: int) -> Column:
        return mode.bitwiseAND(mask) != 0

    def run(r: int, w: int, x: int, special: int, letter: str) -> list[Column]:
        both = F.when(bit(special) & bit(x), letter).when(bit(special), letter.upper())
        return [F.when(bit(r), "r").otherwise("-"), F.when(bit(w), "w").otherwise("-"), both.when(bit(x), "x").otherwise("-")]

    return F.concat(*run(0o400, 0o200, 0o100, 0o4000, "s"), *run(0o040, 0o020, 0o010, 0o2000, "s"), *run(0o004, 0o002, 0o001, 0o1000, "t"))


def file_type(mode: Column) -> Column:
    """Type code of a mode: 1 file, 2 directory, 3 symbolic link, 5 character device, 6 block device, 7 pipe, 8 socket (4, a hard link, is no mode)."""
    kind = mode.bitwiseAND(0o170000)
    out = F.when(kind == 0o100000, 1)
    for code, bits in ((2, 0o040000), (3, 0o120000), (5, 0o020000), (6, 0o060000), (7, 0o010000), (8, 0o140000)):
        out = out.when(kind == bits, code)
    return out.otherwise(0)


def windows_words(bits: Column) -> Column:
    words = F.concat_ws(" ", *(F.when(bits.bitwiseAND(b) != 0, w) for b, w in WINDOWS_WORDS))
    return F.when(words == "", "-").otherwise(words)


def seconds_of_1858(time: Column) -> Column:
    """Seconds since 1970 of a time in 100 ns since 1858 (floor)."""
    ticks = time - F.lit(EPOCH_1858)
    # whole seconds first: a quotient of doubles would round up just below one
    return F.round((ticks - F.pmod(ticks, F.lit(10_000_000))) / 10_000_000).cast("long")


def date_text(time: Column) -> Column:
    """dd-MMM-yyyy hh:mm:ss.cc, the day blank-padded."""
    return F.lpad(F.upper(F.date_format(time, "d-MMM-yyyy HH:mm:ss.SS")), 23, " ")


def protection_mode(protection: Column, is_dir: Column | bool = False) -> Column:
    """POSIX mode of a protection mask (deny bits read, write, execute, delete for system, owner, group, world).

    Execute counts for directories only; a directory keeps all for its owner.
    """
    directory = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir

    def triad(shift: int) -> Column:
        deny = F.shiftright(protection, shift).bitwiseAND(15)
        return F.when(deny.bitwiseAND(1) == 0, 4).otherwise(0) + F.when(deny.bitwiseAND(2) == 0, 2).otherwise(0) + F.when(directory & (deny.bitwiseAND(4) == 0), 1).otherwise(0)

    mode = triad(4) * 64 + triad(8) * 8 + triad(12)
    return F.when(directory, mode.bitwiseOR(0o700)).otherwise(mode).cast("int")


def unix_name(spec: Column) -> Column:
    """Path of a file specification ``[A.B]NAME.TYPE;n``: the top directory and an empty type go."""
    folder = F.regexp_extract(spec, r"^\[([^\]]*)\]", 1)
    folder = F.regexp_replace(folder, r"^000000\.?", "")
    name = F.regexp_replace(F.regexp_replace(spec, r"^\[[^\]]*\]", ""), r";.*$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\.DIR$", ""), r"\.$", "")
    return F.when(folder == "", name).otherwise(F.concat(F.translate(folder, ".", "/"), F.lit("/"), name))


def zero_chunk(data: Column) -> Column:
    return F.hex(data).rlike("^(00)*$")


def parse_time(text: str, now: datetime) -> datetime:
    """A point in time: NOW, TODAY, TOMORROW, YESTERDAY by unambiguous prefix, dd-MMM-yyyy[ hh:mm[:ss]], or -[d-]hh:mm[:ss] before now."""
    word = text.strip().upper()
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    known = {"NOW": now, "TODAY": today, "YESTERDAY": today - timedelta(days=1), "TOMORROW": today + timedelta(days=1)}
    named = [k for k in known if word and k.startswith(word)]
    if len(named) == 1:
        return known[named[0]]
    if m := re.fullmatch(r"-(?:(\d+)[- ])?(\d+):(\d+)(?::(\d+))?", word):
        days, hours, minutes, seconds = (int(x or 0) for x in m.groups())
        return now - timedelta(days=days, hours=hours, minutes=minutes, seconds=seconds)
    for form in ("%d-%b-%Y %H:%M:%S", "%d-%b-%Y %H:%M", "%d-%b-%Y"):
        try:
            return datetime.strptime(word.title(), form)
        except ValueError:
            continue
    raise ValueError(f"no time: {text}")
