"""Maximal cliques of the correlation graph.

Vertices are ordered by an upper bound of their core numbers (degrees after some
rounds of h-indices), then id, so that few neighbours come after a vertex, however
many come before. The search
is cut into problems, one for each vertex at first: the cliques of which it is the
first. A problem has its members, the later neighbours, with the members that
each is paired with, and what excludes: for the earlier neighbours, which
members they are paired with. These come from the triangles, listed at their first
vertex; earlier neighbours of equal pairings are one row, and those without any
are none. So a hub is no row of all its neighbours, but as many rows as it has
triangles, and few later neighbours.

A problem of more than `PROBLEM_ROWS` rows is split by its clique's second vertex,
third vertex and so on: each member begins a problem of the later members paired
with it, and the earlier ones exclude. Splits are a join, and what is left is
searched in one task each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.operators.cores import core_numbers, h_indices
from corrweave.operators.correlate import adjacency
from corrweave.session import Scratch, cut

#: Rounds towards the core numbers that the order takes (None: all); any order gives the same cliques.
ORDER_ROUNDS = 1
PROBLEM_ROWS = 4096


def maximal_sets(p: int, x: int, near: list[int]) -> list[int]:
    """Maximal cliques within `p` that no vertex of `x` extends; sets of vertices are bit masks.

    Bron and Kerbosch's search with Tomita's pivot, on an explicit stack.
    """
    out: list[int] = []
    stack = [(0, p, x)]
    while stack:
        r, p, x = stack.pop()
        if not p:
            if not x:
                out.append(r)
            continue
        pivot, most, rest = 0, -1, p | x
        while rest:
            low = rest & -rest
            u = low.bit_length() - 1
            n = (near[u] & p).bit_count()
            if n > most:
                pivot, most = u, n
            rest ^= low
        todo = p & ~near[pivot]
        while todo:
            low = todo & -todo
            v = low.bit_length() - 1
            stack.append((r | low, p & near[v], x & near[v]))
            p ^= low
            x |= low
            todo ^= low
    return out


_VERTEX = "struct<c: bigint, v: bigint>"
#: path: the first vertices of a clique. kind: "p" for a member m, "x" for what excludes, "o" for the problem itself. near: members paired with the row.
_PROBLEM = ("path", "kind", "m", "near")


def _of_problem(batch: pa.Table) -> pa.Table:
    """Cliques of one problem from its rows."""
    path = batch.column("path")[0].as_py()
    rows = list(zip(batch.column("kind").to_pylist(), batch.column("m").to_pylist(), batch.column("near").to_pylist(), strict=True))
    order = lambda m: (m["c"], m["v"])
    vs = sorted(order(m) for kind, m, _ in rows if kind == "p")
    at = {v: i for i, v in enumerate(vs)}
    near = [0] * len(vs)
    for kind, m, ns in rows:
        mask = sum(1 << at[order(u)] for u in ns or ())
        if kind == "p":
            near[at[order(m)]] |= mask
        elif kind == "x":
            for i in range(len(vs)):
                if mask >> i & 1:
                    near[i] |= 1 << len(near)
            near.append(mask)
    members = (1 << len(vs)) - 1
    found = [sorted([*path, *(v for i, (_, v) in enumerate(vs) if r >> i & 1)]) for r in maximal_sets(members, (1 << len(near)) - 1 & ~members, near)]
    return pa.table({"edges": pa.array(found, pa.list_(pa.int64()))})


def _first_problems(pairs: DataFrame, scratch: Scratch, rounds: int | None) -> DataFrame:
    """The problem of each vertex that has later neighbours."""
    if rounds is None:
        cores = core_numbers(pairs).toDF("v", "c")
    else:
        adj = adjacency(pairs)
        cores = adj.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        for _ in range(rounds):
            cores = h_indices(adj, cores)
    end = lambda i: cores.select(F.col("v").alias(f"e{i}"), F.struct("c", "v").alias(f"x{i}"))
    both = pairs.select("e1", "e2").join(end(1), "e1").join(end(2), "e2")
    later = scratch.keep(both.select(F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b")))
    wedges = later.join(later.select("a", F.col("b").alias("c")), "a").filter(F.col("b") < F.col("c"))
    triangles = scratch.keep(wedges.join(later.toDF("b", "c"), ["b", "c"]).select("a", "b", "c"))
    path = lambda c: F.array(F.col(c)["v"]).alias("path")
    paired = triangles.select(F.col("a"), F.col("b").alias("m"), F.col("c").alias("w")).union(triangles.select("a", "c", "b"))
    near = paired.groupBy("a", "m").agg(F.collect_list("w").alias("near"))
    members = later.select("a", F.col("b").alias("m")).join(near, ["a", "m"], "left")
    members = members.select(path("a"), F.lit("p").alias("kind"), "m", F.coalesce("near", F.array().cast(f"array<{_VERTEX}>")).alias("near"))
    before = triangles.groupBy("a", "b").agg(F.array_sort(F.collect_list("c")).alias("near")).select(path("b"), "near").distinct()
    return members.unionByName(before.select("path", F.lit("x").alias("kind"), F.lit(None).cast(_VERTEX).alias("m"), "near"))


def _split(rows: DataFrame) -> DataFrame:
    """The problems that begin with the members of problems: what is paired with a member, and paired with what is left of the members."""
    begins = rows.filter(F.col("kind") == "p").select("path", F.col("m").alias("v"), F.filter("near", lambda w: w > F.col("m")).alias("left"))
    longer = F.concat("path", F.array(F.col("v")["v"])).alias("path")
    met = rows.filter(F.col("kind") != "o").select("path", "kind", "m", "near", F.explode("near").alias("v")).join(begins, ["path", "v"])
    stays = (F.col("kind") == "p") & (F.col("m") > F.col("v"))
    kind, member = F.when(stays, "p").otherwise("x").alias("kind"), F.when(stays, F.col("m")).alias("m")
    inner = met.select(longer, kind, member, F.array_sort(F.array_intersect("near", "left")).alias("near")).distinct()
    own = begins.select(longer, F.lit("o").alias("kind"), F.lit(None).cast(_VERTEX).alias("m"), F.array().cast(f"array<{_VERTEX}>").alias("near"))
    return inner.unionByName(own)


def maximal_cliques(pairs: DataFrame, problem_rows: int = PROBLEM_ROWS, rounds: int | None = ORDER_ROUNDS) -> DataFrame:
    """`edges` (array<bigint>, ascending) of every maximal clique of the pairs (e1, e2); each has two vertices at least. A checkpoint."""
    scratch = Scratch(pairs.sparkSession, "cliques")
    rows, done = scratch.keep(_first_problems(scratch.keep(pairs.select("e1", "e2").distinct()), scratch, rounds)), []
    while True:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "p").alias("p"))
        large = sizes.filter((F.col("n") > problem_rows) & (F.col("p") > 1)).select("path")
        if large.isEmpty():
            done.append(rows)
            break
        large = scratch.keep(large)
        done.append(rows.join(large, "path", "left_anti"))
        rows = scratch.keep(_split(rows.join(large, "path", "left_semi")))
    out = done[0].select(*_PROBLEM)
    for more in done[1:]:
        out = out.union(more.select(*_PROBLEM))
    out = cut(out.groupBy("path").applyInArrow(_of_problem, "edges array<bigint>"))
    scratch.clear()
    return out


def check_cliques(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, is_clique, is_maximal) of each set: whether every two of its vertices are a pair, and no further vertex is paired with all of them."""
    keyed = sets.select(S.set_text(F.col("edges")).alias("k"), F.array_distinct("edges").alias("edges")).distinct()
    members = keyed.select("k", F.size("edges").alias("n"), F.explode("edges").alias("u"), "edges")
    # For each set and each neighbour of a member: how many members it is paired with.
    met = members.join(adjacency(pairs).distinct(), "u").groupBy("k", "n", "v").agg(F.count(F.lit(1)).alias("m"), F.first(F.array_contains("edges", F.col("v"))).alias("own"))
    counts = met.groupBy("k").agg(F.count_if(F.col("own") & (F.col("m") == F.col("n") - 1)).alias("full"), F.count_if(~F.col("own") & (F.col("m") == F.col("n"))).alias("more"))
    both = keyed.select("k", F.size("edges").alias("n")).join(counts, "k", "left")
    full = (F.coalesce("full", F.lit(0)) == F.col("n")) | (F.col("n") <= 1)
    return both.select("k", full.alias("is_clique"), (full & (F.coalesce("more", F.lit(0)) == 0)).alias("is_maximal"))
