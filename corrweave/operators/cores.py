"""Core numbers of the correlation graph by repeated h-indices (Lü, Zhou, Zhang and Stanley, 2016).

A vertex's core number is the largest k for which it belongs to a subgraph of
degrees k and more. Starting from degrees, every vertex takes the h-index of its
neighbours' values, again and again; values fall until they are the core numbers,
and each round's are upper bounds. A round is a join and two aggregates: the
neighbours' values of a vertex are counted by value, so even a hub is as many
rows as its neighbours have different values, and no row holds a neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrweave.operators.correlate import adjacency
from corrweave.session import Scratch, cut


def h_indices(adj: DataFrame, values: DataFrame) -> DataFrame:
    """(v, c): for each u of `adj` (u, v) the largest h such that h neighbours have values (v, c) of h and more."""
    counts = adj.join(values, "v").groupBy("u", "c").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("c")))
    return counts.select("u", F.least("c", above).alias("h")).groupBy(F.col("u").alias("v")).agg(F.max("h").alias("c"))


def core_numbers(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(edge_id, core) of each vertex of the pairs (e1, e2); after `rounds` rounds, if they are given, an upper bound. A checkpoint."""
    scratch = Scratch(pairs.sparkSession, "cores")
    adj = scratch.keep(adjacency(pairs).distinct())
    values = scratch.keep(adj.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    done = 0
    while rounds is None or done < rounds:
        after = scratch.keep(h_indices(adj, values))
        done += 1
        total = [x.agg(F.sum("c")).first()[0] for x in (values, after)] if rounds is None else None
        values = after
        if total and total[0] == total[1]:  # values only fall, so an equal sum is no change
            break
    out = cut(values.select(F.col("v").alias("edge_id"), F.col("c").alias("core")))
    scratch.clear()
    return out
