"""Names and specifications as column expressions: savesets, wildcards, nodes, bases, valid names, owners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that Windows takes for devices, and characters that it has in no name.
WINDOWS_DEVICES = ["CON", "PRN", "AUX", "NUL"]
WINDOWS_FORBIDDEN = r'[\x01-\x1F<>:"\\|?*]'


def is_saveset_name(spec: Column) -> Column:
    """``-``, or a name that ends in .bck or .sav, in any case, after something."""
    return (spec == "-") | spec.rlike(r"(?is)^.+\.(bck|sav)$")


def has_wildcard(spec: Column) -> Column:
    """A wildcard character, or ``...`` as a whole component."""
    return spec.rlike(r"[*?%]|(^|/)\.\.\.(/|$)")


def node_and_file(spec: Column) -> tuple[Column, Column]:
    """Node and file of ``node::file``; nulls where there is no node. A node is not empty and has no slash."""
    pattern = r"(?s)^(?!::)([^/]+?)::(.+)$"
    there = spec.rlike(pattern)
    return F.when(there, F.regexp_extract(spec, pattern, 1)), F.when(there, F.regexp_extract(spec, pattern, 2))


def upper_ascii(text: Column) -> Column:
    """Upper case of a to z alone."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def number_column(width: int, value: Column) -> Column:
    """A number right-aligned in a column of ``width``, wider if it has more digits."""
    digits = value.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit(" "))


def text_column(width: int, value: Column) -> Column:
    """A text left-aligned in a column of ``width`` octets, wider if it is longer."""
    return F.concat(value, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.octet_length(value), F.lit(0))))


def base_and_kind(spec: Column) -> tuple[Column, Column]:
    """The part of a specification that does not vary, and its kind.

    ``wildcard``: the directories before the first component with a wildcard; ``self``: a directory that stands for
    what it holds; ``plain``: the directory of the name. Trailing slashes say nothing.
    """
    steps = F.split(spec, "/")
    first = F.array_position(F.transform(steps, lambda s: s.rlike(r"[*?%]") | (s == "...")), F.lit(True)).cast("int")
    before = F.array_join(F.slice(steps, 1, F.greatest(first - 1, F.lit(0))), "/")
    varying = F.when(first == 1, ".").when(before == "", "/").otherwise(before)
    plain = F.regexp_replace(spec, "(?<=.)/+$", "")
    itself = plain.rlike(r"(?s)^/$|(^|/)\.\.?$")
    parent = F.regexp_replace(plain, "(?s)/[^/]*$", "")
    above = F.when(~plain.contains("/"), ".").when(parent == "", "/").otherwise(parent)
    kind = F.when(first > 0, "wildcard").when(itself, "self").otherwise("plain")
    return F.when(first > 0, varying).when(itself, plain).otherwise(above), kind


def stored_name_ok(name: Column) -> Column:
    """Relative, no empty, ``.`` or ``..`` component, no NUL."""
    return F.forall(F.split(name, "/"), lambda s: ~s.isin("", ".", "..")) & ~name.contains("\0")


def windows_name_ok(name: Column) -> Column:
    """No component with a forbidden character, a last dot or blank, or the name of a device, with an extension or without."""
    def fine(s: Column) -> Column:
        head = F.upper(F.substring_index(s, ".", 1))
        return ~s.rlike(WINDOWS_FORBIDDEN) & ~s.rlike(r"[. ]$") & ~head.isin(*WINDOWS_DEVICES) & ~head.rlike("^(COM|LPT)[1-9]$")

    return F.forall(F.split(name, "/"), fine)


def protection_text(protection: Column) -> Column:
    """``System:RWED, Owner:RWED, Group:RE, World:`` of a mask of denials, four bits a class."""
    def rights(shift: int) -> Column:
        deny = F.shiftright(protection, shift)
        return F.concat(*(F.when(deny.bitwiseAND(1 << i) == 0, letter).otherwise("") for i, letter in enumerate("RWED")))

    return F.concat(F.lit("System:"), rights(0), F.lit(", Owner:"), rights(4), F.lit(", Group:"), rights(8), F.lit(", World:"), rights(12))


def uic_text(uic: Column) -> Column:
    """``[group,member]``, six octal digits each."""
    return F.format_string("[%06o,%06o]", F.shiftright(uic, 16).bitwiseAND(0xFFFF).cast("int"), uic.bitwiseAND(0xFFFF).cast("int"))
