"""Connected components by randomised contraction (Bögeholz, Brand and Todor, 2019)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.session import Scratch, cut

#: Edges of a task, at least: rounds over few edges take few tasks, however many partitions shuffles have.
TASK_ROWS = 250_000


def representatives(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, rep) for every node of `edges` (columns a and b, long): nodes of one component share `rep`.

    Each round sends every node to the neighbour (or itself) of least random
    rank and replaces the edges by those between the targets, so a constant
    share of the nodes goes each round, for paths and hubs alike. All of it
    are aggregates with partial sums and joins that AQE can split; only whether
    edges are left comes to the driver. The result is a checkpoint.
    `rows`, where it is known, is the number of edges, so that few of them take few tasks from the start.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.keep(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows and -(-rows // TASK_ROWS))
    maps: list[DataFrame] = []
    seed = 0
    while count := edges.count():  # from the footers of a written table
        parts = -(-2 * count // TASK_ROWS)
        seed += 1
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("rank"), F.col(c).alias("to"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("n"))
        target = scratch.keep(best.select("node", F.least(rank("node"), F.col("n"))["to"].alias("to")), parts)
        maps.append(target)
        left = target.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = target.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").filter(F.col("ta") != F.col("tb"))
        edges = scratch.keep(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), parts)
    out = maps[0].select("node", F.col("to").alias("rep")) if maps else edges.select(F.col("a").alias("node"), F.col("b").alias("rep"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("rep"), "to")
        out = out.join(step, "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
    out = cut(out)
    scratch.clear()
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the component is its smallest node."""
    found = representatives(edges)
    least = found.groupBy("rep").agg(F.min("node").alias("component"))
    return found.join(least, "rep").select("node", "component")


def graph_components(edges: DataFrame) -> DataFrame:
    """(edge_id, component): edges that hang together by shared nodes; a component is named by its smallest node."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = edges.select("edge_id", F.col("src").alias("node")).join(found, "node", "left")
    return named.select("edge_id", F.coalesce("component", "node").alias("component"))
