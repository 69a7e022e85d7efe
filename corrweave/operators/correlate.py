"""Correlated pairs of edges: exact (sparse or dense) and by locality-sensitive hashing.

All results are (e1, e2, r) with e1 < e2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.operators.dense import close_pairs
from corrweave.session import cut
from corrweave.sources.graph import snapshots


def _active(edges: DataFrame) -> DataFrame:
    """Edges of a binary graph whose series isn't constant, with their alive snapshots."""
    n = F.size("series")
    return edges.select("edge_id", n.alias("n"), F.size(S.alive(F.col("series"))).cast("long").alias("s"), "series").filter((F.col("s") > 0) & (F.col("s") < F.col("n")))


def _binary_r(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Pearson's r of 0/1 series from counts; the radicand is a whole number."""
    return (n * sxy - sx * sy) / F.sqrt(((n * sx - sx * sx) * (n * sy - sy * sy)).cast("double"))


#: Pairs that one join key of the sparse search makes, at most.
KEY_PAIRS = 4_000_000


def sparse_pairs(edges: DataFrame, min_cor: float, spread: int = 0) -> DataFrame:
    """Pairs of a binary graph with r >= min_cor > 0.

    For 0/1 series a positive r needs a shared snapshot, so an equi-join on
    the snapshot loses nothing; constant series (r undefined) go before it.
    `spread` deals one snapshot's edges to so many join keys: one side by
    edge_id, the other copied to each. Without it, the most crowded snapshot is
    counted, and no key makes more than KEY_PAIRS pairs.
    """
    if not min_cor > 0:
        raise ValueError("the sparse search needs min_cor > 0; use dense_pairs")
    act = _active(edges)
    snap = act.select("edge_id", "n", "s", F.explode(S.alive(F.col("series"))).alias("t"))
    if spread < 1:
        crowd = snap.groupBy("t").count().agg(F.max("count")).first()[0] or 0
        spread = max(1, -(-crowd * crowd // KEY_PAIRS))
    a = snap.select(F.col("edge_id").alias("e1"), F.col("s").alias("s1"), "n", "t", F.pmod("edge_id", F.lit(spread)).cast("int").alias("k"))
    b = snap.select(F.col("edge_id").alias("e2"), F.col("s").alias("s2"), "t")
    b = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))) if spread > 1 else b.withColumn("k", F.lit(0))
    both = a.join(b, ["t", "k"]).filter(F.col("e1") < F.col("e2"))
    counts = both.groupBy("e1", "e2", "n", "s1", "s2").agg(F.count(F.lit(1)).alias("sxy"))
    r = _binary_r(F.col("n"), F.col("s1"), F.col("s2"), F.col("sxy"))
    return counts.select("e1", "e2", r.alias("r")).filter(F.col("r") >= min_cor)


def all_pairs(edges: DataFrame, columns: list[str], blocks: int = 8) -> DataFrame:
    """Every pair e1 < e2 with the given columns as (name1, name2): a blocked equi-join.

    Edges fall into `blocks` by id; each is copied to the keys of the block
    pairs it takes part in, so the work is blocks^2 / 2 independent keys.
    """
    named = edges.select("edge_id", *columns, F.pmod("edge_id", F.lit(blocks)).cast("int").alias("b"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    keyed = named.withColumn("o", F.explode(others)).withColumn("key", F.least("b", "o") * blocks + F.greatest("b", "o"))
    left = keyed.select("key", F.col("b").alias("b1"), F.col("edge_id").alias("e1"), *[F.col(c).alias(f"{c}1") for c in columns])
    right = keyed.select("key", F.col("b").alias("b2"), F.col("edge_id").alias("e2"), *[F.col(c).alias(f"{c}2") for c in columns])
    # Within a key of two different blocks, pairs inside one of them belong to another key.
    apart = (F.col("b1") != F.col("b2")) | (F.col("key") == F.col("b1") * blocks + F.col("b1"))
    return left.join(right, "key").filter((F.col("e1") < F.col("e2")) & apart).drop("key", "b1", "b2")


def dense_pairs(edges: DataFrame, min_cor: float, measure: str = "pearson", blocks: int | None = None) -> DataFrame:
    """Pairs with similarity >= min_cor for any series (weighted, negative) and any threshold.

    Pearson's and the Euclidean measure search by pivots (`dense`, `blocks` of them); others, which may be no metric, compare all pairs.
    """
    if measure in ("pearson", "euclidean"):
        return close_pairs(edges, min_cor, measure, blocks)
    both = all_pairs(edges, ["series"], blocks or 8)
    found = both.select("e1", "e2", S.MEASURES[measure](F.col("series1"), F.col("series2")).alias("r"))
    return found.filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.col("r") >= min_cor))


# --- locality-sensitive hashing -----------------------------------------------------------------------------------

PRIME = 2147483647


def hash_constants(h: int) -> tuple[int, int]:
    """Multiplier and offset of the h-th hash function (t * a + b) mod PRIME; independent orders of the snapshots."""
    return (1103515245 * (h + 1)) % PRIME, (12345 * (h + 1) * (h + 7)) % PRIME


def minhash_codes(edges: DataFrame, hash_funcs: int, hash_runs: int) -> DataFrame:
    """(edge_id, run, code): for each run (band) the joined min-hashes of its functions (rows)."""
    snap = snapshots(edges).select("edge_id", F.col("t").cast("long").alias("t"))
    mins = []
    for h in range(hash_funcs * hash_runs):
        a, b = hash_constants(h)
        mins.append(F.min((F.col("t") * a + b) % PRIME).alias(f"m{h}"))
    signed = snap.groupBy("edge_id").agg(*mins)
    codes = [
        F.struct(F.lit(r).alias("run"), F.concat_ws("-", *[F.col(f"m{r * hash_funcs + f}").cast("string") for f in range(hash_funcs)]).alias("code"))
        for r in range(hash_runs)
    ]
    return signed.select("edge_id", F.explode(F.array(*codes)).alias("x")).select("edge_id", "x.run", "x.code")


def minhash_candidates(edges: DataFrame, hash_funcs: int = 5, hash_runs: int = 2) -> DataFrame:
    """Distinct pairs that share a code in some run. Constant series correlate with nothing, and all share one code where always alive: they go first."""
    varied = edges.filter(F.array_min("series") < F.array_max("series"))
    return _sharing(minhash_codes(varied, hash_funcs, hash_runs))


def _sharing(codes: DataFrame) -> DataFrame:
    """Distinct pairs of edges with a code in common."""
    a = codes.withColumnRenamed("edge_id", "e1")
    b = codes.withColumnRenamed("edge_id", "e2")
    return a.join(b, ["run", "code"]).filter(F.col("e1") < F.col("e2")).select("e1", "e2").distinct()


def verify(candidates: DataFrame, edges: DataFrame, min_cor: float, measure: str = "pearson", weighted: bool = True) -> DataFrame:
    """Candidates whose exact similarity reaches min_cor; 0/1 series compare by counts, as in the sparse search."""
    if measure == "pearson" and not weighted:
        own = _active(edges).select("edge_id", S.alive(F.col("series")).alias("v"), "s", "n")
        x, y = own.toDF("e1", "x", "s1", "n"), own.select("edge_id", "v", "s").toDF("e2", "y", "s2")
        both = candidates.select("e1", "e2").distinct().join(x, "e1").join(y, "e2")
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        return both.select("e1", "e2", _binary_r(F.col("n"), F.col("s1"), F.col("s2"), shared).alias("r")).filter(F.col("r") >= min_cor)
    if measure == "pearson":  # centred once for each edge, not for each pair
        own = edges.select("edge_id", S.centred(F.col("series")).alias("v"))
        own = own.withColumn("len", S.norm(F.col("v"))).filter("len > 0")
        r = S.dot(F.col("x"), F.col("y")) / (F.col("len1") * F.col("len2"))
    else:
        own = edges.select("edge_id", F.col("series").alias("v"), F.lit(1.0).alias("len"))
        r = S.MEASURES[measure](F.col("x"), F.col("y"))
    x, y = own.toDF("e1", "x", "len1"), own.toDF("e2", "y", "len2")
    found = candidates.select("e1", "e2").distinct().join(x, "e1").join(y, "e2").select("e1", "e2", r.alias("r"))
    return found.filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.col("r") >= min_cor))


#: Edges of one code, above which its pairs aren't listed.
CROWD = 1000


def minhash_pairs(edges: DataFrame, min_cor: float, hash_funcs: int = 5, hash_runs: int = 2, weighted: bool = False, crowd: int = CROWD) -> DataFrame:
    """Pairs that share a code in some run, with r >= min_cor.

    Codes of up to `crowd` edges list their pairs, which are verified. The edges of
    larger ones, whose pairs would grow with the square, are searched by pivots, where
    only pairs that reach min_cor are rows, and those that share such a code are kept.
    The result is the same for any `crowd`.
    """
    varied = edges.filter(F.array_min("series") < F.array_max("series"))
    codes = cut(minhash_codes(varied, hash_funcs, hash_runs))
    large = codes.groupBy("run", "code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("run", "code")
    if large.isEmpty():
        return verify(_sharing(codes), edges, min_cor, weighted=weighted)
    large = cut(large)
    found = verify(_sharing(codes.join(large, ["run", "code"], "left_anti")), edges, min_cor, weighted=weighted)
    hot = codes.join(large, ["run", "code"], "left_semi").select("edge_id", "run", "code")
    close = close_pairs(varied.join(hot.select("edge_id").distinct(), "edge_id", "left_semi"), min_cor, "pearson" if weighted else "binary")
    kept = close.join(hot.toDF("e1", "run", "code"), "e1").join(hot.toDF("e2", "run", "code"), ["e2", "run", "code"]).select("e1", "e2", "r")
    return found.union(kept).dropDuplicates(["e1", "e2"])


def correlated_pairs(
    edges: DataFrame, min_cor: float, exact: bool = True, weighted: bool = False, hash_funcs: int = 5, hash_runs: int = 2, spread: int = 0
) -> DataFrame:
    """Pairs with Pearson's r >= min_cor, by the plan that fits the graph."""
    if not exact:
        return minhash_pairs(edges, min_cor, hash_funcs, hash_runs, weighted)
    if weighted or min_cor <= 0:
        return dense_pairs(edges, min_cor)
    return sparse_pairs(edges, min_cor, spread)


def adjacency(pairs: DataFrame) -> DataFrame:
    """(u, v) in both directions."""
    return pairs.select(F.col("e1").alias("u"), F.col("e2").alias("v")).union(pairs.select("e2", "e1"))


def degrees(pairs: DataFrame) -> DataFrame:
    """(edge_id, degree) in the correlation graph."""
    return adjacency(pairs).groupBy(F.col("u").alias("edge_id")).agg(F.count(F.lit(1)).alias("degree"))


def degrees_in_sets(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, edge_id, near, far, largeness) for the edges of each set: neighbours and others among the rest of the set, and near / size of the set."""
    keyed = sets.select(S.set_text(F.col("edges")).alias("k"), F.array_distinct("edges").alias("edges"))
    placed = keyed.select("k", F.size("edges").alias("n"), F.explode("edges").alias("edge_id"), "edges")
    near = F.coalesce(F.size(F.array_intersect("edges", "vs")), F.lit(0)).cast("long")
    around = adjacency(pairs).groupBy(F.col("u").alias("edge_id")).agg(F.collect_set("v").alias("vs"))
    both = placed.join(around, "edge_id", "left").select("k", "edge_id", "n", F.when(F.col("vs").isNull(), F.lit(0)).otherwise(near).cast("long").alias("near"))
    return both.select("k", "edge_id", "near", (F.col("n") - 1 - F.col("near")).cast("long").alias("far"), (F.col("near") / F.col("n")).alias("largeness"))
