import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mining import table

from corrweave.operators import correlate as cor
from corrweave.operators import dense
from corrweave.session import Scratch


def weighted(seed, n=60, t=12, shapes=6):
    rnd = random.Random(seed)
    base = [[rnd.choice([0, 1, 2, 5, -3]) + rnd.random() for _ in range(t)] for _ in range(shapes)]
    return {e: [x * rnd.choice([1, 1, 2]) + rnd.gauss(0, 0.4) for x in rnd.choice(base)] for e in range(n)}


def rows(df):
    got = df.collect()
    assert len({(r["e1"], r["e2"]) for r in got}) == len(got)
    return {(r["e1"], r["e2"]): r["r"] for r in got}


@pytest.mark.parametrize(("pivots", "part_rows"), [(1, 1024), (7, 1024), (9, 4), (200, 3)])
@pytest.mark.parametrize("bound", [0.9, 0.3, -0.4])
def test_pearson_against_all_pairs(spark, pivots, part_rows, bound):
    series = weighted(pivots) | {90: [1.0] * 12, 91: [0.0] * 12, 92: [1.0, 2.0] * 6, 93: [2.0, 4.0] * 6}
    edges = table(spark, {e: (e, e + 1) for e in series}, series)
    got = rows(dense.close_pairs(edges, bound, "pearson", pivots, part_rows))
    expected = brute.pairs(series, bound)
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-9 for p in got) and (92, 93) in got


@pytest.mark.parametrize("bound", [0.9, 0.2, 0.0])
def test_euclidean_against_all_pairs(spark, bound):
    series = weighted(3) | {90: [1.0] * 12, 91: [1.0] * 12}
    edges = table(spark, {e: (e, e + 1) for e in series}, series)
    got = rows(dense.close_pairs(edges, bound, "euclidean", 6, 7))
    all_ = {(a, b): 1 / (1 + np.sqrt(sum((x - y) ** 2 for x, y in zip(series[a], series[b], strict=True)))) for a in series for b in series if a < b}
    expected = {p: r for p, r in all_.items() if r >= bound}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-12 for p in got) and got[90, 91] == 1.0


def test_binary_series_compare_as_in_the_sparse_search(spark):
    rnd = random.Random(5)
    series = {e: [rnd.randint(0, 1) for _ in range(9)] for e in range(80)} | {99: [1] * 9}
    edges = table(spark, {e: (e, e + 1) for e in series}, series)
    for bound in (0.3, 0.5, 1.0):
        assert rows(dense.close_pairs(edges, bound, "binary", 6, 9)) == rows(cor.sparse_pairs(edges, bound))


def test_blocks_apart_are_skipped(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(8, 30))
    series = {e: (base[e % 8] + rnd.normal(scale=0.02, size=30)).tolist() for e in range(160)}
    edges = table(spark, {e: (e, e + 1) for e in series}, series)
    scratch = Scratch(spark, "test")
    plan = dense.plan_blocks(edges, 0.9, "pearson", scratch, pivots=40)
    assert plan.skipped > 0.5 and sum(plan.parts.values()) >= 8
    assert dense.plan_blocks(edges, -1.0, "pearson", scratch, pivots=40).skipped == 0
    assert rows(dense.close_pairs(edges, 0.9, pivots=40)).keys() == brute.pairs(series, 0.9).keys()
    scratch.clear()
    assert dense.close_pairs(edges.filter("edge_id < 0"), 0.5).count() == 0
    assert rows(dense.close_pairs(edges.filter("edge_id < 1"), 0.5)) == {}


def test_other_measures_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setitem(cor.S.MEASURES, "first", lambda x, y: F.when(F.get(x, F.lit(0)) == F.get(y, F.lit(0)), 1.0).otherwise(0.0))
    series = {0: [1, 0], 1: [1, 1], 2: [0, 1], 3: [1, 0]}
    assert rows(cor.dense_pairs(table(spark, {e: (e, e + 1) for e in series}, series), 0.5, "first", blocks=3)).keys() == {(0, 1), (0, 3), (1, 3)}


@pytest.mark.parametrize("weights", [False, True])
def test_crowded_codes_give_the_same_pairs(spark, weights):
    """Half of all edges share a code; its pairs aren't listed, and the result is that of listing them."""
    rnd = random.Random(7)
    hot = [1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    flip = lambda s: [1 - x if rnd.random() < 0.08 else x for x in s]
    series = {e: [1, *flip(hot)] if e % 2 else [rnd.randint(0, 1) for _ in range(13)] for e in range(120)}
    if weights:
        series = {e: [x * rnd.uniform(1, 3) for x in s] for e, s in series.items()}
    edges = table(spark, {e: (e, e + 1) for e in series}, series)
    listed = rows(cor.minhash_pairs(edges, 0.5, 1, 3, weighted=weights))
    crowded = rows(cor.minhash_pairs(edges, 0.5, 1, 3, weighted=weights, crowd=10))
    assert listed.keys() == crowded.keys() and all(abs(listed[p] - crowded[p]) < 1e-9 for p in listed) and len(listed) > 500
    exact = brute.pairs(series, 0.5)
    assert crowded.keys() <= exact.keys()


def test_crowded_snapshots_are_spread(spark, monkeypatch):
    rnd = random.Random(8)
    series = {e: [rnd.randint(0, 1) for _ in range(8)] for e in range(70)}
    edges = table(spark, {e: (e, e + 1) for e in series}, series)
    whole = rows(cor.sparse_pairs(edges, 0.4, spread=1))
    monkeypatch.setattr(cor, "KEY_PAIRS", 100)
    assert rows(cor.sparse_pairs(edges, 0.4)) == whole
