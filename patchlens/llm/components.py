"""Connected components of an edge table by alternating large-star and small-star steps, all as DataFrame operations.

Each step replaces a vertex' edges by edges to its smallest neighbour, so the graph turns into stars around the smallest
vertex of each component within O(log^2 n) steps. A vertex with very many edges is a skewed join key whose other side has
one row a key: the planner splits it. Nothing but two numbers a step (a checksum) comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _smallest(df: DataFrame) -> DataFrame:
    return df.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    others = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``edges(u, v)``; root is the smallest vertex of the component.

    Null ends, loops and repeated edges are dropped (a vertex that has only loops is in no row). An empty table gives an
    empty one.
    """
    edges = cut(edges.select("u", "v").where("u <> v").distinct())
    last = _checksum(edges)
    if not last[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        edges = cut(_small_star(_large_star(edges)))
        if (now := _checksum(edges)) == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
