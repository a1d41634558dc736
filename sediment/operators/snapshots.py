"""Comparison, journals, chains and losses over snapshots of entries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differs(columns: list[str], left: str = "l", right: str = "r") -> Column:
    """Any column differs, nulls being equal to each other."""
    return reduce(lambda a, b: a | b, (~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def changed_since(found: DataFrame, journal: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Entries that the journal lacks or has with another state."""
    joined = found.alias("l").join(journal.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "left")
    return joined.filter(F.col(f"r.{key}").isNull() | differs(columns)).select("l.*")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate with map-side combining, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(best).select(*keys, "_last.*").select(*rows.columns)


def first_difference(saved: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One report for each saved row: ``missing``, the first differing column, or ``same``.

    The saved side drives; rows that are only found are not reported.
    """
    on = reduce(lambda a, b: a & b, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys))
    joined = saved.alias("l").join(found.withColumn("_there", F.lit(True)).alias("r"), on, "left")
    report = F.when(F.col("r._there").isNull(), "missing")
    for c in columns:
        report = report.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c)
    return joined.select(*(f"l.{k}" for k in keys), report.otherwise("same").alias("difference"))


#: Octets of a data record: content is compared record by record.
RECORD_OCTETS = 1 << 20


def first_octet(a: Column, b: Column) -> Column:
    """Place of the first octet in which two binary columns differ as far as both go; null if in none, or if one is null.

    Vectors of octets have no built-in function that isn't quadratic in them, so this one is Python's.
    """

    @F.pandas_udf("long")
    def place(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None:
                return None
            n = min(len(p), len(q))
            other = np.flatnonzero(np.frombuffer(p, np.uint8, n) != np.frombuffer(q, np.uint8, n))
            return int(other[0]) if len(other) else None

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="Int64")

    return place(a, b)


def compare_entries(saved: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """One report for each saved entry (key, ftype, link, content): the first difference of what is found, or ``same``.

    Entries have to be there, of the same type, links with the same target; regular files are
    compared record by record: a record that the found file has no longer is ``shorter``, one with other bytes
    ``octet N``; after them the sizes. Modes, owners and times are not compared, and what is only found is not reported.
    """
    columns = ["ftype", "link", "content"]
    joined = saved.select(key, *(F.col(c).alias(f"s_{c}") for c in columns)).join(found.select(key, F.lit(True).alias("there"), *(F.col(c).alias(f"f_{c}") for c in columns)), key, "left")
    a, b = F.coalesce(F.length("s_content"), F.lit(0)), F.coalesce(F.length("f_content"), F.lit(0))
    # the first record that is not all there; octets after its begin are not compared
    cut = F.when(b < a, F.floor(b / RECORD_OCTETS) * RECORD_OCTETS).otherwise(a)
    # equal contents stay where they are: only others go to Python
    other = ~F.col("s_content").eqNullSafe(F.col("f_content"))
    octet = first_octet(F.when(other, F.col("s_content")), F.when(other, F.col("f_content")))
    report = F.when(F.col("there").isNull(), "missing").when(F.col("s_ftype") != F.col("f_ftype"), "type")
    report = report.when(~F.col("s_link").eqNullSafe(F.col("f_link")), "link")
    report = report.when(F.col("octet") < cut, F.concat(F.lit("octet "), "octet")).when(b < a, "shorter").when(b > a, "size")
    return joined.withColumn("octet", octet).select(key, report.otherwise("same").alias("difference"))


def lost(catalog: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Catalogued rows that were not delivered."""
    return catalog.join(delivered, key, "left_anti")


def prune_children(found: DataFrame, directories: DataFrame, names: DataFrame, parent: str, path: str) -> DataFrame:
    """Found children of catalogued directories whose names the catalog lacks: what a restore removes."""
    return found.join(directories, parent, "left_semi").join(names, path, "left_anti")


def chain_restore(links: list[DataFrame], key: str, deleted: str) -> DataFrame:
    """State after a chain, oldest first: the last link that has a key wins; deletions apply."""
    tagged = [link.withColumn("_link", F.lit(i)) for i, link in enumerate(links)]
    together = reduce(DataFrame.unionByName, tagged)
    return latest(together, [key], ["_link"]).filter(~F.col(deleted)).drop("_link", deleted)


def first_names(entries: DataFrame, identity: list[str], order: str, name: str) -> DataFrame:
    """Further names of one identity become links to its first name (null for the first)."""
    mine = [F.col(c).alias(f"_of_{c}") for c in identity]
    first = entries.groupBy(*mine).agg(F.min_by(name, order).alias("_first"), F.min(order).alias("_at"))
    # equal identities with nulls in them are one group, as in the aggregate
    joined = entries.join(first, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in identity)))
    rest = [c for c in entries.columns if c not in identity]
    joined = joined.select(*identity, *rest, "_first", "_at")
    return joined.withColumn("link", F.when(F.col(order) != F.col("_at"), F.col("_first"))).drop("_first", "_at")


def delete_candidates(catalog: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Catalogued rows still found in exactly the catalogued state."""
    on = reduce(lambda a, b: a & b, (catalog[c].eqNullSafe(found[c]) for c in [key, *columns]))
    return catalog.join(found, on, "left_semi")


def covered_not_saved(covered: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    return covered.join(saved, key, "left_anti")


def union_specs(parts: list[DataFrame]) -> DataFrame:
    """Concatenation with the number of the input, duplicates kept."""
    return reduce(DataFrame.unionByName, (p.withColumn("baseidx", F.lit(i)) for i, p in enumerate(parts)))


def upsert_keeping_place(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key at the place of its first."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    out = rows.groupBy(key).agg(F.min(seq).alias(seq), F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return out.select(key, seq, "_last.*")


def islands(rows: DataFrame, partition: list[str], order: str, lost_col: str) -> DataFrame:
    """Runs of good rows between losses: adds ``island``; lost rows go."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.col(lost_col).cast("long")).over(w)).filter(~F.col(lost_col))
