"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import dropped, written

#: A node with more links than this, and more than a MOST_HOT-th of all link ends, is hot. There are MOST_HOT of them at most, whatever the graph.
HOT_LINKS, MOST_HOT = 256, 200_000


def _least_by_node(rows: DataFrame, low: DataFrame, links: int) -> DataFrame:
    """(v, m): rows (u, v) with the value m of low (u, m, n: rows of u) instead of u.

    Rows meet low by a join on the node, but for hot nodes: their values (MOST_HOT rows at most) are broadcast, so that no task takes all rows of a
    large star.
    """
    bar = max(HOT_LINKS, -(-2 * links // MOST_HOT))
    marked = rows.join(F.broadcast(low.where(F.col("n") > bar).select("u", F.col("m").alias("hot"))), "u", "left")
    cold = marked.where("hot is null").select("u", "v").join(low.where(F.col("n") <= bar).select("u", "m"), "u").select("v", "m")
    return cold.unionByName(marked.where("hot is not null").select("v", F.col("hot").alias("m")))


def _large_stars(edges: DataFrame, links: int) -> DataFrame:
    """Each greater neighbour of a node, linked with the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return _least_by_node(both.where("v > u"), least, links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_stars(edges: DataFrame, links: int) -> DataFrame:
    """Each node's lesser neighbours, linked with the least of them; and the node itself. links: a bound of the rows of edges."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = _least_by_node(down, low, links).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of links (u > v, all different), and whether they are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    links, stars = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.min(F.expr("up + down <= 1")), F.lit(True))).first()
    return links, stars


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every end of `edges` (u, v long): the least node it is linked with, itself included.

    Each round's links are written to the shared folder, until they are stars. The number of rounds grows with the square of the logarithm of the longest
    path at most; `rounds` is a guard against links that change between reads, and an error.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    links, stars = _state(edges)
    for _ in range(rounds):
        if stars:
            break
        large = written(_large_stars(edges, links), "large")
        new = written(_small_stars(large, links), "stars")
        dropped(edges, large)
        edges = new
        links, stars = _state(edges)
    else:
        raise RuntimeError("components: no fixed point")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
