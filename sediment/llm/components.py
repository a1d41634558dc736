"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import drop_scratch, materialize

EDGES_A_TASK = 100_000


def star(edges: DataFrame, large: bool, step: int, width: int) -> DataFrame:
    """One star step over undirected edges (a, b).

    large: neighbours above a node move to its least neighbour; small: the node and its
    neighbours below it do.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the least neighbours are written apart, so that the join has plain shuffles on both sides, which AQE can split
    lows = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(width), f"star-{step}")
    joined = both.join(lows, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct().coalesce(width)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b long); the component is its least node.

    Self edges and repeated edges are allowed; an empty table gives no rows. Stops when a
    round changes nothing, which is when every node points at its component's least node.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for step in itertools.count():
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        width = math.ceil(mark[0] / EDGES_A_TASK)  # tables of few edges are written by few tasks
        large = materialize(star(now, True, step, width), "large-star")
        old, now = now, materialize(star(large, False, step, width), "small-star")
        drop_scratch(old)
        drop_scratch(large)
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
