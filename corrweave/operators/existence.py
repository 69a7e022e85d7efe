"""Whether sets of edges hold a dense part, for all sets at once by bulk peeling.

Each round is a few aggregates over the edges that are left of the undecided
sets: degrees and weights of nodes, the node of least (degree, weight, id) as a
minimum of structs, counts of snapshots, densities. Sets that are dense, or can't
become so, are decided; the others lose their least node. No window, no group
that is collected: a set of any size is as many rows as it has edges. Rounds are as
many as the nodes of the largest set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.operators.density import members
from corrweave.session import Scratch, cut


def _nodes(left: DataFrame, by_weight: bool) -> DataFrame:
    """(k, n, most, low) of each set: its nodes, the highest degree, and the node of least (degree, weight, id)."""
    ends = left.select("k", F.explode(F.array("src", "dst")).alias("node"), "support")
    weight = F.sum("support") if by_weight else F.lit(0.0)
    nodes = ends.groupBy("k", "node").agg(F.count(F.lit(1)).alias("degree"), weight.alias("weight"))
    least = F.min(F.struct("degree", "weight", "node"))
    return nodes.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("most"), least["node"].alias("low"))


def _snapshots(left: DataFrame, k: int) -> DataFrame:
    """(k, k_snaps, skipped, fewest) of each set; a snapshot in which only loops of one node are alive has no density."""
    loop = F.col("src") == F.col("dst")
    alive = left.select("k", F.explode("alive").alias("t"), F.when(loop, F.col("src")).alias("loop"))
    touched = (F.count_if(F.col("loop").isNull()) > 0) | (F.min("loop") < F.max("loop"))
    counts = alive.groupBy("k", "t").agg(F.count(F.lit(1)).alias("m"), touched.alias("apart"))
    full = F.col("m") >= max(1, k)
    return counts.groupBy("k").agg(
        F.count_if(full).alias("k_snaps"),
        F.coalesce(F.sum(F.when(~full, F.col("m"))), F.lit(0)).alias("skipped"),
        F.min(F.when(full, F.when(F.col("apart"), F.col("m")).otherwise(0))).alias("fewest"),
    )


def contains_dense(sets: DataFrame, edges: DataFrame, k: int, min_den: float, density: str = "min") -> DataFrame:
    """(k, contains): for each distinct set whether peeling nodes of least (degree, id), or by average density (degree, weight, id), meets a set of density `min_den`. A checkpoint."""
    scratch = Scratch(sets.sparkSession, "existence")
    keyed = members(sets.select(F.array_distinct("edges").alias("edges")).distinct(), edges)
    left = scratch.keep(keyed.select("k", "src", "dst", "support", S.alive(F.col("series")).alias("alive")))
    names = scratch.keep(sets.select(S.set_text(F.array_distinct("edges")).alias("k")).distinct())
    true: DataFrame | None = None
    while left.count():  # from the footers of a written table
        totals = left.groupBy("k").agg(F.sum("support").alias("total"))
        state = _nodes(left, density == "avg").join(_snapshots(left, k), "k", "left").join(totals, "k")
        value = 2.0 * F.col("fewest") / F.col("n")
        if density == "avg":
            value = 2.0 * (F.col("total") - F.col("skipped")) / F.nullif(F.col("k_snaps") * F.col("n"), F.lit(0))
        hopeless = (F.col("n") < 2) | (F.col("most") < min_den) | (F.coalesce("k_snaps", F.lit(0)) == 0)
        seen = scratch.keep(state.filter(~hopeless).select("k", "low", (value >= min_den).alias("dense")))
        hit = seen.filter("dense").select("k")
        true = hit if true is None else true.union(hit)
        rest = left.join(seen.filter("NOT dense").select("k", "low"), "k").filter("src <> low AND dst <> low")
        left = scratch.keep(rest.drop("low"))
    found = true if true is not None else names.select("k").limit(0)
    out = cut(names.join(found.withColumn("contains", F.lit(True)), "k", "left").select("k", F.coalesce("contains", F.lit(False)).alias("contains")))
    scratch.clear()
    return out
