"""Selection of catalog entries: patterns, scopes, times and owners as column predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS = 64
MAX_DEPTH = 256


def pattern_regex(pattern: str) -> str:
    """Regular expression of a name pattern: ``*`` is any run, ``%`` and ``?`` one character."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c in "%?" else re.escape(c) for c in pattern) + "$"


def like_pattern(pattern: str) -> str:
    """LIKE pattern (escape: backslash) of a name pattern."""
    return "".join("%" if c == "*" else "_" if c in "%?" else f"\\{c}" if c in "_\\" else c for c in pattern)


def split_list(text: str) -> list[str]:
    """A comma list whose items may be quoted; patterns beyond the limit are ignored."""
    return [quoted or plain for quoted, plain in re.findall(r'"([^"]*)"|([^",]+)', text)][:MAX_PATTERNS]


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a whole name matches any pattern; no patterns match nothing."""
    return reduce(lambda a, b: a | b, (path.like(like_pattern(p)) for p in patterns[:MAX_PATTERNS]), F.lit(False))


def select(entries: DataFrame, path: str, patterns: list[str], exclude: list[str] = (), is_dir: Column | None = None) -> DataFrame:
    """Entries not excluded and selected. ``is_dir`` passes directories by, as a tree walk does."""
    out = entries.filter(~matches(F.col(path), list(exclude))) if exclude else entries
    if not patterns:
        return out
    chosen = matches(F.col(path), patterns)
    return out.filter(chosen if is_dir is None else is_dir | chosen)


def prune_below(entries: DataFrame, path: str, heads: DataFrame) -> DataFrame:
    """Entries that are neither among ``heads`` (one column of paths) nor below one of them."""
    heads = heads.toDF("_head")
    steps = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    below = entries.select(path, F.explode(prefixes).alias("_head")).join(heads, "_head", "left_semi").select(path).distinct()
    return entries.join(below, path, "left_anti")


def prune_subtrees(entries: DataFrame, path: str, exclude: list[str]) -> DataFrame:
    """Entries that neither match ``exclude`` nor lie below an entry that does (a walk's exclusion)."""
    return prune_below(entries, path, entries.filter(matches(F.col(path), exclude)).select(path))


def without_nodump(entries: DataFrame, path: str, nodump: Column, is_dir: Column) -> DataFrame:
    """A flagged directory goes with all it holds, a flagged regular file alone; a null flag is none."""
    flagged = F.coalesce(nodump, F.lit(False))
    return prune_below(entries.filter(~(flagged & ~is_dir)), path, entries.filter(flagged & is_dir).select(path))


def time_of(source: str, modified: Column, created: Column, changed: Column) -> Column:
    """The time that a selection goes by: ``modified``, ``created`` (null where the file system has none) or ``changed``."""
    return {"modified": modified, "created": created, "changed": changed}[source]


def chosen_by_time(time: Column, since=None, before=None) -> Column:
    """Half-open interval [since, before); a missing time is not chosen when a bound is given."""
    out = F.lit(True)
    if since is not None:
        out = out & (time >= since)
    if before is not None:
        out = out & (time < before)
    return F.coalesce(out, F.lit(False))


def below_depth(path: Column, most: int = MAX_DEPTH) -> Column:
    return F.size(F.split(path, "/")) <= most


def within(path: Column, names: list[str]) -> Column:
    """The named entries and all below them; a trailing slash is ignored."""
    parts = (n.rstrip("/") for n in names)
    return reduce(lambda a, b: a | b, ((path == n) | path.startswith(n + "/") for n in parts), F.lit(False))


def safe_name(path: Column) -> Column:
    """Not empty, not absolute, no NUL and no ``..`` component."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.contains("\0") & ~path.rlike(r"(^|/)\.\.(/|$)")


def path_order(path: str) -> list[Column]:
    """Order of a directory walk: component by component, not by the whole string."""
    return [F.split(F.col(path), "/")]
