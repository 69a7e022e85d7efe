import random

import brute
import pytest
from pyspark.sql import functions as F

from corrweave.operators import cliques as cliq
from corrweave.operators.cores import core_numbers, h_indices


def pairs_of(spark, pairs):
    return spark.createDataFrame([(*sorted(p), 0.9) for p in pairs], "e1 long, e2 long, r double").repartition(3)


def cores_by_removal(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, k = {}, 0
    while near:
        v = min(near, key=lambda x: (len(near[x]), x))
        k = max(k, len(near[v]))
        out[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return out


def graphs():
    rnd = random.Random(1)
    for base, (n, p) in enumerate([(9, 0.5), (12, 0.3), (10, 0.8), (14, 0.15), (6, 1.0), (11, 0.6)]):
        yield [(100 * base + a, 100 * base + b) for a in range(n) for b in range(a + 1, n) if rnd.random() < p]


def found(df):
    rows = [tuple(r["edges"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_core_numbers(spark):
    pairs = [p for g in graphs() for p in g] + [(900, 901 + i) for i in range(30)] + [(950 + i, 951 + i) for i in range(12)]
    got = {r["edge_id"]: r["core"] for r in core_numbers(pairs_of(spark, pairs)).collect()}
    assert got == cores_by_removal(pairs)
    first = {r["edge_id"]: r["core"] for r in core_numbers(pairs_of(spark, pairs), rounds=1).collect()}
    assert all(first[v] >= got[v] for v in got) and first != got
    assert core_numbers(pairs_of(spark, pairs).filter("e1 < 0")).count() == 0


def test_a_hub_is_many_rows(spark):
    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    values = hub.select("v", (F.col("v") % 7).alias("c"))
    assert h_indices(hub, values).first()["c"] == 6


@pytest.mark.parametrize(("rows", "rounds"), [(4096, 2), (0, 1), (3, 0), (6, None)])
def test_cliques_against_brute_force(spark, rows, rounds):
    for g in [sum(graphs(), [])]:
        expected = set().union(*(brute.cliques(set(x)) for x in graphs()))
        assert found(cliq.maximal_cliques(pairs_of(spark, g), rows, rounds)) == expected


def test_hubs_are_split(spark):
    """A hub before many and after many: all of its cliques, and no problem beyond the bound in one group."""
    rim = [(1 + i, 1 + (i + 1) % 400) for i in range(400)]
    pairs = [(0, 1 + i) for i in range(400)] + rim
    got = found(cliq.maximal_cliques(pairs_of(spark, pairs), problem_rows=50))
    assert got == {tuple(sorted((0, *p))) for p in rim}
    blob = [(10_000 + a, 10_000 + b) for a in range(14) for b in range(a + 1, 14) if (a + b) % 5]
    whole = found(cliq.maximal_cliques(pairs_of(spark, blob)))
    assert found(cliq.maximal_cliques(pairs_of(spark, blob), problem_rows=8)) == whole and len(whole) > 5
