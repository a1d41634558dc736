"""Lines of listings in the short, full and long formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions.names import number_column, text_column
from sediment.functions.scalars import TYPE_LETTERS, date_text, permissions
from sediment.sources.blocks import DIRECTORY

#: Names of types and states in full listings.
TYPE_NAMES = ["?", "file", "directory", "symlink", "hard link", "character device", "block device", "FIFO", "socket"]
STATUS_NAMES = ["OK", "changed while saved", "read error"]


def named(code: Column, names: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code), F.lit("?"))


def mode_letters(ftype: Column, mode: Column) -> Column:
    return F.concat(named(ftype, TYPE_LETTERS), permissions(mode))


def brief_line(path: Column, ftype: Column, size: Column, time: Column) -> Column:
    """Name, size and time to the minute; a directory's name alone, with a slash."""
    minute = F.substring(date_text(time), 1, 17)
    return F.when(ftype == DIRECTORY, F.concat(path, F.lit("/"))).otherwise(F.concat(text_column(46, path), F.lit("  "), number_column(12, size), F.lit("  "), minute))


def full_lines(path: Column, ftype: Column, size: Column, uname: Column, gname: Column, uid: Column, gid: Column, mode: Column, time: Column, crc: Column, status: Column, link: Column) -> Column:
    """Three lines on an entry, a fourth one on where a link points."""
    owner = F.format_string("%s:%s (%d,%d)", F.coalesce(uname, F.lit("?")), F.coalesce(gname, F.lit("?")), uid, gid)
    second = F.concat(F.lit("    Type: "), text_column(12, named(ftype, TYPE_NAMES)), F.lit("  Size: "), text_column(14, size.cast("string")), F.lit("  Owner: "), owner, F.lit("  Protection: "), mode_letters(ftype, mode))
    third = F.concat(F.lit("    Modified: "), date_text(time), F.lit("  Checksum: "), F.format_string("%08X", crc), F.lit("  Status: "), named(status, STATUS_NAMES))
    return F.concat_ws("\n", path, second, third, F.concat(F.lit("    Link to: "), link))


def long_line(path: Column, ftype: Column, mode: Column, nlink: Column, uname: Column, gname: Column, size: Column, time: Column, link: Column) -> Column:
    """A line as file managers read it; a hard link shows as a file that points to its first name."""
    who = [text_column(8, F.coalesce(n, F.lit("?"))) for n in (uname, gname)]
    line = F.concat_ws(" ", mode_letters(ftype, mode), number_column(3, F.greatest(F.coalesce(nlink, F.lit(1)), F.lit(1))), who[0])
    line = F.concat(line, F.lit("  "), who[1], F.lit("  "), number_column(10, size), F.lit(" "), F.date_format(time, "MM-dd-yyyy HH:mm:ss"), F.lit(" "), path)
    return F.concat(line, F.coalesce(F.concat(F.lit(" -> "), link), F.lit("")))
