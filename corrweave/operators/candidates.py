"""Candidate subgraphs: connected parts of cliques, in the original graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.operators.setjoin import named, not_contained


def split_connected(ids: list[int], ends: list[tuple[int, int]]) -> list[list[int]]:
    """Edges grouped by whether they hang together by shared nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in ends:
        parent[root(u)] = root(v)
    groups: dict[int, list[int]] = {}
    for e, (u, _) in sorted(zip(ids, ends, strict=True)):
        groups.setdefault(root(u), []).append(e)
    return list(groups.values())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for members in b.column(0).to_pylist():
            found += split_connected([m["edge_id"] for m in members], [(m["src"], m["dst"]) for m in members])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["edges"])


def connected_parts(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct connected parts (`edges`, ascending, and `n_edges`) of sets of edges."""
    keyed = sets.select(S.set_text(F.col("edges")).alias("k"), F.explode("edges").alias("edge_id"))
    members = keyed.join(edges.select("edge_id", "src", "dst"), "edge_id").groupBy("k").agg(F.collect_list(F.struct("edge_id", "src", "dst")).alias("m"))
    parts = members.select("m").mapInArrow(_parts, "edges array<bigint>")
    return parts.distinct().withColumn("n_edges", F.size("edges"))


def candidates(cliques: DataFrame, edges: DataFrame, min_den: float) -> DataFrame:
    """Connected parts with at least min_den edges."""
    return connected_parts(cliques, edges).filter(F.col("n_edges") >= min_den)


def maximal_only(sets: DataFrame) -> DataFrame:
    """Sets with more than one edge that are part of no other."""
    many = named(sets.filter(F.size("edges") > 1))
    return not_contained(many, many, strict=True).select("edges", F.size("edges").alias("n_edges"))


def overlaps(sets: DataFrame) -> DataFrame:
    """Jaccard similarity of every two sets that share an edge (edges1 < edges2 as text)."""
    keyed = sets.select(S.set_text(F.col("edges")).alias("k"), "edges", F.explode("edges").alias("e"))
    a = keyed.select(F.col("k").alias("k1"), F.col("edges").alias("x"), "e")
    b = keyed.select(F.col("k").alias("k2"), F.col("edges").alias("y"), "e")
    both = a.join(b, "e").filter(F.col("k1") < F.col("k2"))
    shared = both.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("x")).alias("nx"), F.first(F.size("y")).alias("ny"))
    return shared.select("k1", "k2", (F.col("n") / (F.col("nx") + F.col("ny") - F.col("n"))).alias("jaccard"))
