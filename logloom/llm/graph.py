"""Connected components without a driver: rounds of large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself. A table of its own, so that the join after it can split a hub's rows."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v: long, not null; any order, repeats and loops allowed) -> (node, component) with the smallest
    node of each component, for every node of an edge with two ends. No edges: no rows.

    A round costs two aggregations that combine map-side and two joins that AQE can split, so a hub is no hot task;
    the number of rounds grows with the logarithm of a component's diameter."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node is tied to the smallest one.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        discard(least)
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        low = _least(large)
        tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = materialize(tied, "edges")
        discard(low)
        discard(large)
        mark = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = nxt
        if mark == was or not mark[0]:
            break
        was = mark
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
