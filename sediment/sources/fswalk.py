"""Data source ``fswalk``: a directory tree as rows.

Options: ``path`` (a folder that all executors see), ``pattern`` (component by component, ``...``
for any number of levels), ``exclude`` (comma list; an excluded directory's subtree is not
entered), ``crossDevice`` (default true; if false, a mount point is listed but not entered),
``maxDepth`` (256). The entries of the upper folders are a partition each, and so is every tree below them, once
there are enough trees. Order rows by ``split(path, "/")`` for walk order.
"""

from __future__ import annotations

import os
import re
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sediment.operators.selection import MAX_DEPTH, pattern_regex, split_list

SCHEMA = "path string, ftype int, mode int, uid long, gid long, size long, mtime_sec long, mtime_nsec int, ctime_sec long, ctime_nsec int, dev decimal(20,0), ino decimal(20,0), nlink long, link string"
#: Types 1 to 8 by mode.
TYPES = {stat.S_IFREG: 1, stat.S_IFDIR: 2, stat.S_IFLNK: 3, stat.S_IFCHR: 5, stat.S_IFBLK: 6, stat.S_IFIFO: 7, stat.S_IFSOCK: 8}


def path_regex(pattern: str) -> str:
    """Wildcards within a component; a component ``...`` is zero or more levels."""
    steps = []
    for step in pattern.split("/"):
        steps.append("(?:[^/]+/)*" if step == "..." else "".join("[^/]*" if c == "*" else "[^/]" if c in "%?" else re.escape(c) for c in step) + "/")
    return "^" + "".join(steps).removesuffix("/") + "$"


class Folder(InputPartition):
    def __init__(self, name: str, deep: bool):
        super().__init__((name, deep))
        self.name, self.deep = name, deep


#: Folder levels that planning looks into, and the number of trees it stops at.
LEVELS, TREES = 4, 64


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/")
        self.exclude = [re.compile(pattern_regex(p)) for p in split_list(options.get("exclude", ""))]
        self.pattern = re.compile(path_regex(options["pattern"])) if options.get("pattern") else None
        self.cross, self.depth = options.get("crossdevice", "true").lower() != "false", int(options.get("maxdepth", MAX_DEPTH))

    def partitions(self):
        """The entries of the upper folders one by one, and whole trees below them once there are enough of those."""
        out, level, home = [], [""], os.lstat(self.root).st_dev
        for _ in range(LEVELS):
            out += [Folder(p, False) for p in level]
            level = [c for p in level for c in self.folders_in(p, home)]
            if len(level) >= TREES:
                break
        return out + [Folder(p, True) for p in level]

    def folders_in(self, path: str, home: int) -> list[str]:
        here = f"{self.root}/{path}"
        if path and (path.count("/") + 2 > self.depth or not self.cross and os.lstat(here).st_dev != home):
            return []
        try:
            names = sorted(e.name for e in os.scandir(here) if e.is_dir(follow_symlinks=False))
        except OSError:
            return []
        return [p for n in names if not self.excluded(p := f"{path}/{n}" if path else n)]

    def excluded(self, path: str) -> bool:
        return any(p.match(path) for p in self.exclude)

    def read(self, partition):
        home, path = os.lstat(self.root).st_dev, partition.name
        depth = path.count("/") + 2
        if partition.deep:
            yield from self.below(path, depth, home)
        elif not path or depth <= self.depth and (self.cross or os.lstat(f"{self.root}/{path}").st_dev == home):
            try:
                names = sorted(os.listdir(f"{self.root}/{path}"), key=os.fsencode)
            except OSError:
                return
            for name in names:
                full = f"{path}/{name}" if path else name
                if not self.excluded(full):
                    yield from self.row(full)

    def below(self, path: str, depth: int, home: int):
        here = f"{self.root}/{path}"
        if depth > self.depth or not self.cross and os.lstat(here).st_dev != home:
            return
        try:
            names = sorted(os.listdir(here), key=os.fsencode)
        except OSError:
            return
        for name in names:
            full = f"{path}/{name}"
            if self.excluded(full):
                continue
            yield from self.row(full)
            if os.path.isdir(f"{here}/{name}") and not os.path.islink(f"{here}/{name}"):
                yield from self.below(full, depth + 1, home)

    def row(self, path: str):
        if self.pattern and not self.pattern.match(path):
            return
        try:
            s = os.lstat(f"{self.root}/{path}")
        except OSError:
            return
        from decimal import Decimal

        link = os.readlink(f"{self.root}/{path}") if stat.S_ISLNK(s.st_mode) else None
        yield path, TYPES.get(stat.S_IFMT(s.st_mode), 0), stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_ctime_ns // 10**9, s.st_ctime_ns % 10**9, Decimal(s.st_dev), Decimal(s.st_ino), s.st_nlink, link


class WalkSource(DataSource):
    @classmethod
    def name(cls):
        return "fswalk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader({k.lower(): v for k, v in self.options.items()})  # names of options have no case


def walk(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(WalkSource)
    return spark.read.format("fswalk").options(path=path, **options).load()
