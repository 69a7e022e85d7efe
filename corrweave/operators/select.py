"""The greedy choice of diverse results, in rounds.

Results are taken one after the other by a fixed order, and each set taken
excludes later ones: those that are part of it, and those whose Jaccard
similarity with it reaches a bound. Which sets exclude which is a join
(`setjoin`), a table of conflicts from earlier to later. A set without an undecided
earlier one is taken, all that it excludes go, and both leave the table. Each
round decides many sets at once, wherever they are; the result is that of going
through the order one by one.

First the candidates, largest first (ties by their edges): one of `max_cc_size`
edges or more goes; one that is taken excludes by itself if it is dense, and
otherwise by its extracted parts, and these by inclusion only. Then the parts of
the candidates taken, largest first, under both tests against each other and the
dense candidates taken. With `max_jac <= 0` the first dense candidate, or without
one the first part, is the only result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.operators.setjoin import contained_pairs, not_contained, similar_pairs
from corrweave.session import Scratch, cut


def first_come(items: DataFrame, conflicts: DataFrame, scratch: Scratch) -> DataFrame:
    """The items (k) that stay if each one, in an order that every row (early, late) of `conflicts` follows, excludes its later ones; tables of the rounds are in `scratch`."""
    left = scratch.keep(conflicts.select("early", "late").distinct())
    kept = items.select("k")
    while left.count():  # from the footers of a written table
        free = left.select(F.col("early").alias("k")).distinct().join(left.select(F.col("late").alias("k")), "k", "left_anti")
        gone = scratch.keep(left.join(free, F.col("early") == F.col("k"), "left_semi").select(F.col("late").alias("k")).distinct())
        kept = kept.join(gone, "k", "left_anti")
        undecided = left.join(gone, F.col("early") == F.col("k"), "left_anti").join(gone, F.col("late") == F.col("k"), "left_anti")
        left = scratch.keep(undecided)
    return kept


def _in_order(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(early, late) of pairs (k1, k2) of `sets` (k, edges): larger sets come first, then those of lesser edges."""
    x = lambda i: sets.select(F.col("k").alias(f"k{i}"), F.struct((-F.size("edges")).alias("n"), "edges").alias(f"o{i}"))
    both = pairs.select("k1", "k2").join(x(1), "k1").join(x(2), "k2")
    first = F.col("o1") < F.col("o2")
    return both.select(F.when(first, F.col("k1")).otherwise(F.col("k2")).alias("early"), F.when(first, F.col("k2")).otherwise(F.col("k1")).alias("late"))


def _first(sets: DataFrame) -> DataFrame:
    return sets.orderBy(F.size("edges").desc(), "edges").limit(1)


def diverse(classified: DataFrame, max_cc_size: int, max_jac: float) -> DataFrame:
    """The accepted sets of (cand, class, sets): edges, n_edges, density, origin ("direct" or "extracted"). A checkpoint; `classified` is read several times."""
    scratch = Scratch(classified.sparkSession, "diverse")
    fit = classified.filter((F.size("cand") < max_cc_size) & (F.size("sets") > 0))
    live = fit.select(S.set_text(F.col("cand")).alias("k"), F.array_sort("cand").alias("edges"), "class", "sets")
    direct = live.filter(F.col("class") == "direct").select("k", "edges", F.col("sets")[0]["density"].alias("density"))
    made = live.filter(F.col("class") == "extracted").select(F.col("k").alias("owner"), F.explode("sets").alias("s"))
    parts = made.select("owner", S.set_text(F.col("s.edges")).alias("k"), F.array_sort("s.edges").alias("edges"), "s.density")
    cands, one = live.select("k", "edges"), max_jac <= 0
    near = 0 < max_jac < 1  # similarity 1 means equal, which inclusion covers

    holders = parts.select("owner", "k", "edges")
    if not one:
        holders = holders.union(direct.select("k", "k", "edges"))
    held = holders.select("k", "edges").dropDuplicates(["k"])
    inside = contained_pairs(cands, held).join(holders.select(F.col("k").alias("k2"), "owner"), "k2")
    conflicts = inside.select(F.col("owner").alias("early"), F.col("k1").alias("late")).filter("early <> late")
    if near:
        similar = _in_order(similar_pairs(cands, bound=max_jac), cands)
        conflicts = conflicts.union(similar.join(direct.select("k"), F.col("early") == F.col("k"), "left_semi"))
    passing = first_come(cands, conflicts, scratch)

    accepted = scratch.keep(direct.join(passing, "k", "left_semi"))
    loose = parts.join(passing.select(F.col("k").alias("owner")), "owner", "left_semi").dropDuplicates(["k"]).select("k", "edges", "density")
    if one:
        best = accepted if not accepted.isEmpty() else loose
        chosen, origin = _first(best), "direct" if not accepted.isEmpty() else "extracted"
        out = chosen.select("edges", F.size("edges").alias("n_edges"), "density", F.lit(origin).alias("origin"))
    else:
        free = not_contained(loose, accepted)
        if near:
            free = free.join(similar_pairs(free, accepted, max_jac).select(F.col("k1").alias("k")), "k", "left_anti")
        free = scratch.keep(free)
        inner = contained_pairs(free, free).filter("k1 <> k2").select(F.col("k2").alias("early"), F.col("k1").alias("late"))
        if near:
            inner = inner.union(_in_order(similar_pairs(free, bound=max_jac), free))
        chosen = loose.join(first_come(free, inner, scratch), "k", "left_semi")
        both = accepted.withColumn("origin", F.lit("direct")).unionByName(chosen.withColumn("origin", F.lit("extracted")))
        out = both.select("edges", F.size("edges").alias("n_edges"), "density", "origin")
    out = cut(out)
    scratch.clear()
    return out
