"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: label is the smallest node reachable. Every round is
    two grouped minima and is written to the shared folder; labels, never neighbour lists, are gathered."""
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    last = None
    for k in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour (itself included)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        # small star: the smaller neighbours of a node and the node are linked to the smallest of them
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        e = materialize(small, f"edges-{k}")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).head()
        if last == tuple(now):
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)
