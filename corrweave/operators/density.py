"""k-snapshots, densities and degrees as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S


def members(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, edge_id, src, dst, support, series) for the edges of each set; k is the set as text."""
    keyed = sets.select(S.set_text(F.col("edges")).alias("k"), F.explode("edges").alias("edge_id"))
    return keyed.join(edges.select("edge_id", "src", "dst", "support", "series"), "edge_id")


def alive_counts(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, t, m, active): edges of each set alive in each snapshot where any is, and the nodes they touch."""
    x = members(sets, edges).select("k", "src", "dst", F.explode(S.alive(F.col("series"))).alias("t"))
    touched = F.size(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst")))))
    return x.groupBy("k", "t").agg(F.count(F.lit(1)).alias("m"), touched.alias("active"))


def k_snapshots(sets: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(k, t, m): the snapshots with at least `k` (and at least one) edges alive."""
    return alive_counts(sets, edges).filter(F.col("m") >= max(1, k)).select("k", "t", "m")


def densities(sets: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """One row for each set: n_edges, n_nodes, k_snaps, skipped, support, min_density, avg_density (null without k-snapshots).

    min_density: the least, over k-snapshots, of 2 * edges alive / nodes of
    the set. avg_density: 2 * (support - skipped) / (k-snapshots * nodes).
    """
    full = F.col("m") >= max(1, k)
    by_t = alive_counts(sets, edges).groupBy("k").agg(
        F.count_if(full).alias("k_snaps"),
        F.coalesce(F.sum(F.when(~full, F.col("m"))), F.lit(0)).alias("skipped"),
        F.min(F.when(full, F.when(F.col("active") < 2, F.lit(0)).otherwise(F.col("m")))).alias("least"),
    )
    ends = F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))
    base = members(sets, edges).groupBy("k").agg(F.count(F.lit(1)).alias("n_edges"), F.size(ends).cast("long").alias("n_nodes"), F.sum("support").alias("support"))
    both = base.join(by_t, "k", "left")
    some = F.col("k_snaps") > 0
    return both.select(
        "k", "n_edges", "n_nodes",
        F.coalesce("k_snaps", F.lit(0)).alias("k_snaps"),
        F.coalesce("skipped", F.lit(0)).alias("skipped"),
        "support",
        F.when(some, 2.0 * F.col("least") / F.col("n_nodes")).alias("min_density"),
        F.when(some, 2.0 * (F.col("support") - F.col("skipped")) / F.nullif(F.col("k_snaps") * F.col("n_nodes"), F.lit(0))).alias("avg_density"),
    )


def direct_dense(sets: DataFrame, edges: DataFrame, k: int, min_den: float, density: str) -> DataFrame:
    """The sets that are dense as they are."""
    return densities(sets, edges, k).filter(F.col(f"{density}_density") >= min_den)


def snapshot_degrees(edges: DataFrame) -> DataFrame:
    """(t, node, degree); a self-loop counts twice."""
    x = edges.select("src", "dst", F.explode(S.alive(F.col("series"))).alias("t"))
    return x.select("t", F.explode(F.array("src", "dst")).alias("node")).groupBy("t", "node").agg(F.count(F.lit(1)).alias("degree"))


def snapshot_averages(edges: DataFrame) -> DataFrame:
    """(t, n_nodes, avg_degree, min_node, min_degree) over the nodes alive in t; ties of degree go to the smaller node."""
    least = F.min(F.struct("degree", "node"))
    x = snapshot_degrees(edges).groupBy("t").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("avg_degree"), least.alias("x"))
    return x.select("t", "n_nodes", "avg_degree", F.col("x.node").alias("min_node"), F.col("x.degree").alias("min_degree"))


def static_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, n_neighbours)."""
    x = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("x"))
    return x.groupBy("x.node").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("x.other").alias("n_neighbours"))


def is_connected(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, connected): whether each set's edges hang together by shared nodes."""
    from corrweave.operators.candidates import connected_parts

    parts = connected_parts(sets, edges).select(S.set_text(F.col("edges")).alias("k"), F.lit(True).alias("whole"))
    keyed = sets.select(S.set_text(F.col("edges")).alias("k")).distinct()
    return keyed.join(parts, "k", "left").select("k", F.coalesce("whole", F.lit(False)).alias("connected"))
