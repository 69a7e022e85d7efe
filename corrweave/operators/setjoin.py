"""Joins of sets of edges by inclusion and by Jaccard similarity, over indexes of rare edges.

Sets are rows (k, edges): a name and an array of ids. The edges of a set are put
in one order, rare ones first (by the number of sets with an edge, then its id),
with counts over all sets of both sides. Set x can only be part of y if y holds
x's rarest edge, so the index has one key for x, and no key meets more sets than
hold the edge that is rarest in x. Two sets of similarity t share one of the
first n - ceil(t n) + 1 edges of each, so these are the keys, and sizes must lie
within a factor t. What is left is tested by 64-bit signatures (inclusion), then
exactly. Keys that stay large are split by AQE, as both joins are plain equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S


def named(sets: DataFrame) -> DataFrame:
    """(k, edges) of the distinct sets in a column `edges`: k is the set as text."""
    return sets.select(S.set_text(F.col("edges")).alias("k"), F.array_sort(F.array_distinct("edges")).alias("edges")).dropDuplicates(["k"])


def signature(edges: Column) -> Column:
    """A long with one bit set for each edge: that of a part lies within that of the whole."""
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(e), F.lit(64)).cast("int"))
    return F.aggregate(edges, F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(bit(e)))


def rare_first(sets: DataFrame, *others: DataFrame) -> DataFrame:
    """(k, edges, n, rare): rare is the set's edges by (number of sets with the edge, edge), over `sets` and `others`."""
    counted = sets.select(F.explode("edges").alias("e"))
    for other in others:
        counted = counted.union(other.select(F.explode("edges")))
    counts = counted.groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    placed = sets.select("k", F.explode("edges").alias("e")).join(counts, "e")
    ordered = placed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("o"))
    return sets.select("k", "edges", F.size("edges").alias("n")).join(ordered, "k").select("k", "edges", "n", F.transform("o", lambda x: x["e"]).alias("rare"))


def _parts(inner: DataFrame, outer: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides, and the condition under which a row of `inner` is part of one of `outer`."""
    a = rare_first(inner, outer).select("k", "edges", "n", F.get("rare", F.lit(0)).alias("e"), signature(F.col("edges")).alias("sig"))
    b = outer.select(F.col("k").alias("k2"), F.col("edges").alias("edges2"), F.size("edges").alias("n2"), signature(F.col("edges")).alias("sig2"), F.explode("edges").alias("e2"))
    within = (F.col("e") == F.col("e2")) & (F.col("n") <= F.col("n2")) & (F.col("sig").bitwiseAND(F.bitwise_not("sig2")) == 0) & S.contained(F.col("edges"), F.col("edges2"))
    return a, b, within


def contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(k1, k2): sets k1 of `inner`, not empty, that are part of, or equal to, sets k2 of `outer`."""
    a, b, within = _parts(inner, outer)
    return a.join(b, within).select(F.col("k").alias("k1"), "k2")


def not_contained(inner: DataFrame, outer: DataFrame, strict: bool = False) -> DataFrame:
    """(k, edges) of `inner` that are part of no set of `outer`; with `strict`, an equal set doesn't count. Empty sets stay."""
    a, b, within = _parts(inner, outer)
    inside = a.join(b, within & (F.col("n") < F.col("n2")) if strict else within, "left_semi").select("k")
    return inner.select("k", "edges").join(inside, "k", "left_anti")


def similar_pairs(left: DataFrame, right: DataFrame | None = None, bound: float = 0.5) -> DataFrame:
    """(k1, k2, jaccard) of sets of `left` and `right` with a similarity of at least `bound` > 0; without `right`, of two sets of `left`, k1 < k2."""
    if not bound > 0:
        raise ValueError("the bound of similar_pairs is above 0: all disjoint sets reach 0")
    names = ("k", "edges", "n", "pre", "e")

    def prefixes(sets: DataFrame, *others: DataFrame) -> DataFrame:
        # A hair off the bound only makes prefixes longer; the similarity itself is exact.
        length = F.col("n") - F.ceil(F.col("n") * bound - 1e-9).cast("int") + 1
        cut = rare_first(sets, *others).select("k", "edges", "n", F.slice("rare", F.lit(1), F.greatest(F.lit(0), F.least("n", length))).alias("pre"))
        return cut.withColumn("e", F.explode("pre"))

    a = prefixes(left, *([right] if right is not None else [])).toDF(*(f"{c}1" for c in names))
    b = (prefixes(right, left) if right is not None else prefixes(left)).toDF(*(f"{c}2" for c in names))
    sizes = (F.col("n1") >= F.col("n2") * bound - 1e-9) & (F.col("n2") >= F.col("n1") * bound - 1e-9)
    both = a.join(b, (F.col("e1") == F.col("e2")) & sizes & (F.lit(True) if right is not None else F.col("k1") < F.col("k2")))
    # A pair meets at each edge that both prefixes hold; the first of them counts.
    once = both.filter(F.col("e1") == F.get(F.array_intersect("pre1", "pre2"), F.lit(0)))
    shared = F.size(F.array_intersect("edges1", "edges2"))
    scored = once.select("k1", "k2", (shared / (F.col("n1") + F.col("n2") - shared)).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= bound)
