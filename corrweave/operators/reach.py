"""Reachable nodes by breadth-first hops.

The frontier of all sources together is rows (source, node): a hop is a join with
the neighbours, restricted to the allowed nodes, and an anti-join with what was
visited. Visited rows are written tables, one for each hop, so a hop reads them and
nothing is computed again; only the size of the frontier comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.session import Scratch, cut


def neighbours(links: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(node, other), once each, of undirected links (a, b) without loops; `allowed` (node) restricts the others."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).filter("node <> other").distinct()
    return both if allowed is None else both.join(allowed.select(F.col("node").alias("other")), "other", "left_semi").select("node", "other")


def reachable(links: DataFrame, sources: DataFrame, allowed: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(source, node, hops): the least number of links (a, b) from each source (source) to each node, by allowed nodes (node) alone.

    A source reaches itself in 0 hops whether it is allowed, or linked, or not. A checkpoint.
    """
    scratch = Scratch(links.sparkSession, "reach")
    near = scratch.keep(neighbours(links, allowed))
    frontier = scratch.keep(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("hops")).distinct())
    visited, hops = frontier, 0
    while frontier.count() and (max_hops is None or hops < max_hops):  # from the footers of a written table
        hops += 1
        met = frontier.join(near, "node").select("source", F.col("other").alias("node")).distinct()
        frontier = scratch.keep(met.join(visited.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hops).cast("long")))
        visited = visited.union(frontier)
    out = cut(visited)
    scratch.clear()
    return out
