import random
from dataclasses import replace

import brute
import pytest
from pyspark.sql import functions as F

from corrweave.config import MineConfig
from corrweave.operators import candidates as cand
from corrweave.operators import cliques as cliq
from corrweave.operators import correlate as cor
from corrweave.operators import density as den
from corrweave.operators.components import components
from corrweave.operators.lattice import classify
from corrweave.operators.peel import Candidate, Rules
from corrweave.plans import mine as M
from corrweave.plans import views
from corrweave.sources import graph as G

F1 = """1 2 1,1,0,1,0,0
1 3 1,1,0,1,0,0
2 3 1,1,0,1,0,0
3 4 1,1,0,1,0,1
4 5 0,0,1,0,1,0
5 6 0,0,1,0,1,0
4 6 0,0,1,0,1,0
6 7 1,1,1,1,1,1
1 7 1,0,1,0,0,1
"""


@pytest.fixture(scope="module")
def f1(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("f1") / "f1.txt"
    path.write_text(F1)
    return M.load(spark, MineConfig(path=str(path)))


def table(spark, ends, series):
    rows = [(e, *ends[e], 1, [float(x) for x in series[e]]) for e in ends]
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, label int, series array<double>")
    return df.withColumn("support", F.size(F.filter("series", lambda x: x > 0)).cast("double"))


def random_graph(seed, n_edges=12, n_nodes=6, t=6):
    rnd = random.Random(seed)
    every = [(a, b) for a in range(n_nodes) for b in range(a + 1, n_nodes)]
    ends = dict(enumerate(rnd.sample(every, min(n_edges, len(every)))))
    shapes = [[rnd.randint(0, 1) for _ in range(t)] for _ in range(3)]
    flip = lambda x: 1 - x if rnd.random() < 0.12 else x
    return ends, {e: [flip(x) for x in rnd.choice(shapes)] for e in ends}


def sets(df):
    return {tuple(r["edges"]) for r in df.collect()}


def test_load_f1(spark, f1):
    rows = f1.orderBy("edge_id").collect()
    assert [r["support"] for r in rows] == [3, 3, 3, 4, 2, 2, 2, 6, 3]
    assert [(r["src"], r["dst"]) for r in rows[:4]] == [(0, 1), (0, 2), (1, 2), (2, 3)]


def test_f1_pairs_cliques_candidates(spark, f1):
    pairs = cor.sparse_pairs(f1, 0.6)
    assert {(r["e1"], r["e2"]) for r in pairs.collect()} == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6)}
    cliques = cliq.maximal_cliques(pairs)
    assert sets(cliques) == {(0, 1, 2, 3), (4, 5, 6)}
    assert sets(cand.candidates(cliques, f1, 2)) == {(0, 1, 2, 3), (4, 5, 6)}


def test_f1_density(spark, f1):
    one = spark.createDataFrame([([0, 1, 2, 3],)], "edges array<long>")
    got = den.densities(one, f1, 1).first()
    assert (got["k_snaps"], got["skipped"], got["min_density"], got["avg_density"]) == (4, 0, 0.5, 1.625)
    got = den.densities(one, f1, 4).first()
    assert (got["k_snaps"], got["skipped"], got["min_density"], got["avg_density"]) == (3, 1, 2.0, 2.0)
    assert den.densities(one, f1, 5).first()["min_density"] is None


@pytest.mark.parametrize(
    ("density", "min_den", "k", "max_jac", "expected"),
    [
        ("min", 2, 1, 1.0, [(4, 5, 6), (0, 1, 2)]),
        ("avg", 2, 1, 1.0, [(4, 5, 6), (0, 1, 2)]),
        ("min", 1.5, 1, 1.0, [(4, 5, 6), (0, 1, 2)]),
        ("avg", 1.5, 1, 1.0, [(0, 1, 2, 3), (4, 5, 6)]),
        ("avg", 1.9, 2, 0.5, [(0, 1, 2, 3), (4, 5, 6)]),
        ("min", 2, 4, 1.0, [(0, 1, 2, 3)]),
        ("min", 1.5, 1, 0.0, [(4, 5, 6)]),
    ],
)
def test_f1_runs(f1, density, min_den, k, max_jac, expected):
    config = MineConfig(min_cor=0.6, min_den=min_den, min_edges_in_snap=k, density=density, max_cc_size=40, max_jac=max_jac)
    assert sets(M.mine(f1, config)) == set(expected)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    ends, series = random_graph(seed)
    edges = table(spark, ends, series)
    expected = brute.pairs(series, 0.5)
    pairs = cor.sparse_pairs(edges, 0.5, spread=1 + seed % 2 * 2).cache()
    got = {(r["e1"], r["e2"]): r["r"] for r in pairs.collect()}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-9 for p in got)
    assert {(r["e1"], r["e2"]) for r in cor.dense_pairs(edges, 0.5 - 1e-9, blocks=3).collect()} == expected.keys()
    cliques = cliq.maximal_cliques(pairs).cache()
    assert sets(cliques) == brute.cliques(expected)
    whole = {p for c in brute.cliques(expected) for p in brute.parts(c, ends)}
    cands = cand.candidates(cliques, edges, 1).cache()
    assert sets(cands) == whole
    for k in (1, 2):
        for r in den.densities(cands, edges, k).collect():
            members = [int(x) for x in r["k"].split(",")]
            for kind in ("min", "avg"):
                d = brute.density(members, ends, series, k, kind)
                assert (r[f"{kind}_density"] is None) == (d is None)
                assert d is None or abs(r[f"{kind}_density"] - d) < 1e-9


def test_peel_against_brute_force():
    for seed in range(120):
        ends, series = random_graph(seed, n_edges=9)
        for kind in ("min", "avg"):
            for k, delta in ((1, 1.2), (2, 1.6)):
                rules = Rules(delta, k, kind, prune=False)
                ids = list(ends)
                c = Candidate(ids, [ends[e] for e in ids], [series[e] for e in ids], [sum(series[e]) for e in ids], rules)
                assert {tuple(s) for s, _ in c.extract_dense()} == brute.lattice(ids, ends, series, k, kind, delta)
                for s, d in c.extract_dense():
                    assert d == pytest.approx(brute.density(s, ends, series, k, kind)) and d >= delta
                if c.extract_dense():
                    assert c.contains_dense(delta / 2)
                first = c.extract_dense(first_only=True)
                assert len(first) == min(1, len(c.extract_dense()))


def test_choice_is_diverse_and_maximal():
    rnd = random.Random(1)
    rows = [(sorted(rnd.sample(range(20), rnd.randint(2, 7))), "direct", []) for _ in range(60)]
    rows = [(c, k, [(c, 1.0)]) for c, k, _ in rows]
    for bound in (0.3, 1.0):
        got = [set(e) for e, _, _ in brute.choose(rows, 6, bound)]
        assert got and all(len(s) < 6 for s in got)
        for i, a in enumerate(got):
            for b in got[i + 1 :]:
                assert not b <= a and len(a & b) / len(a | b) < bound
    assert len(brute.choose(rows, 100, 0.0)) == 1


def test_choice_is_the_same_by_component(spark):
    ends, series = random_graph(7, n_edges=14)
    edges = table(spark, ends, series)
    config = MineConfig(min_cor=0.4, min_den=1.2, min_edges_in_snap=1, max_cc_size=10, max_jac=0.6)
    found = M.classified(edges, config).cache()
    rows = [(r["cand"], r["class"], [(s["edges"], s["density"]) for s in r["sets"]]) for r in found.collect()]
    whole = {tuple(e) for e, _, _ in brute.choose(rows, 10, 0.6)}
    assert sets(M.mine(edges.repartition(3), config)) == whole


def test_minhash(spark):
    ends, series = random_graph(5, n_edges=14, t=10)
    series[3] = list(series[0])
    edges = table(spark, ends, series)
    exact = {(r["e1"], r["e2"]) for r in cor.sparse_pairs(edges, 0.5).collect()}
    few = {(r["e1"], r["e2"]) for r in cor.minhash_candidates(edges, 2, 2).collect()}
    more = {(r["e1"], r["e2"]) for r in cor.minhash_candidates(edges, 2, 6).collect()}
    assert few <= more and (not any(series[0]) or (0, 3) in few)
    got = {(r["e1"], r["e2"]) for r in cor.minhash_pairs(edges, 0.5, 2, 6).collect()}
    assert got == exact & more
    orders = set()
    for h in range(6):
        a, b = cor.hash_constants(h)
        orders.add(tuple(sorted(range(50), key=lambda t: (t * a + b) % cor.PRIME)))
    assert len(orders) == 6


def test_degenerate_graphs(spark):
    ends = {0: (0, 1), 1: (1, 2), 2: (3, 3), 3: (0, 1)}
    series = {0: [0, 0, 0], 1: [1, 1, 1], 2: [1, 0, 1], 3: [1, 0, 1]}
    edges = table(spark, ends, series)
    assert {(r["e1"], r["e2"]) for r in cor.sparse_pairs(edges, 0.5).collect()} == {(2, 3)}
    config = MineConfig(min_cor=0.5, min_den=1.0, min_edges_in_snap=1, max_jac=1.0)
    assert M.mine(edges, replace(config, min_den=9.0)).count() == 0
    assert M.mine(edges.filter("edge_id < 2"), config).count() == 0
    assert M.mine(edges.filter("edge_id < 0"), config).count() == 0
    assert M.mine(edges, replace(config, max_cc_size=1)).count() == 0
    with pytest.raises(ValueError):
        cor.sparse_pairs(edges, 0.0)


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(sorted(rnd.sample(range(200, 260), 2))) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for v in list(parent):
        groups.setdefault(root(v), []).append(v)
    assert got == {v: min(g) for g in groups.values() for v in g}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_maximal_only_and_overlaps(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([2, 3, 4],), ([5],), ([1, 2, 3],)], "edges array<long>")
    assert sets(cand.maximal_only(df)) == {(1, 2, 3), (2, 3, 4)}
    got = {(r["k1"], r["k2"]): r["jaccard"] for r in cand.overlaps(df.distinct()).collect()}
    assert got[("1,2,3", "2,3,4")] == 0.5 and got[("1,2", "1,2,3")] == pytest.approx(2 / 3)


def test_views(spark, f1):
    wanted = f1.filter("edge_id < 4").select(F.col("dst").alias("source"), F.col("src").alias("target"))
    rows = views.exploded_view(f1, wanted, 4).collect()
    assert {r["number"] for r in rows} == {0, 1, 3} and len(rows) == 12
    rows = views.exploded_view(f1, wanted, 1).collect()
    assert [(r["source"], r["target"]) for r in rows if r["number"] == 5] == [(2, 3)]
    found = M.mine(f1, MineConfig(min_cor=0.6, min_den=1.5, min_edges_in_snap=1, density="avg", max_cc_size=40, max_jac=1.0)).cache()
    import json

    doc = json.loads(views.result_json(found, f1))
    assert doc["densities"] == [{"id": 2, "value": 1.625}, {"id": 1, "value": 2.0}]
    assert [n["name"] for n in doc["nodes"]][:2] == [3, 4] and {e["sids"] for e in doc["edges"]} == {"10", "21"}
    assert views.result_json(found.filter("n_edges > 99"), f1) == ""


def test_classify_is_parallel_and_total(spark, f1):
    cands = spark.createDataFrame([([0, 1, 2, 3],), ([4, 5, 6],), ([7],)], "edges array<long>")
    got = {tuple(r["cand"]): r["class"] for r in classify(cands, f1, Rules(2.0, 1, "min")).collect()}
    assert got == {(0, 1, 2, 3): "extracted", (4, 5, 6): "direct", (7,): "pruned"}


def test_classify_deals_candidates_to_tasks(spark, f1):
    cands = spark.createDataFrame([([i, j],) for i in range(9) for j in range(i + 1, 9)], "edges array<long>")
    tasks = classify(cands, f1, Rules(2.0, 1, "min")).withColumn("p", F.spark_partition_id())
    assert tasks.select("p").distinct().count() > 1


def test_constant_edges_form_no_hashed_pairs(spark):
    ends = {e: (e, e + 1) for e in range(40)}
    series = {e: [1, 1, 1, 1] for e in range(38)} | {38: [1, 0, 1, 0], 39: [1, 0, 1, 0]}
    got = cor.minhash_candidates(table(spark, ends, series), 2, 2).collect()
    assert [(r["e1"], r["e2"]) for r in got] == [(38, 39)]


def test_clique_checks_degrees_and_graph_components(spark, f1):
    pairs = cor.sparse_pairs(f1, 0.6).cache()
    df = spark.createDataFrame([([0, 1, 2, 3],), ([0, 1, 2],), ([0, 4],), ([4, 5, 6],), ([8],)], "edges array<long>")
    got = {r["k"]: (r["is_clique"], r["is_maximal"]) for r in cliq.check_cliques(df, pairs).collect()}
    assert got == {"0,1,2,3": (True, True), "0,1,2": (True, False), "0,4": (False, False), "4,5,6": (True, True), "8": (True, True)}
    assert {r["edge_id"]: r["degree"] for r in cor.degrees(pairs).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 2}
    near = {(r["k"], r["edge_id"]): (r["near"], r["far"], r["largeness"]) for r in cor.degrees_in_sets(df, pairs).collect()}
    assert near["0,1,2,3", 0] == (3, 0, 0.75) and near["0,4", 4] == (0, 1, 0.0) and near["8", 8] == (0, 0, 0.0)
    parts = spark.createDataFrame([(0, 5, 6), (1, 6, 7), (2, 9, 9), (3, 10, 11)], "edge_id long, src long, dst long")
    from corrweave.operators.components import graph_components

    assert {r["edge_id"]: r["component"] for r in graph_components(parts).collect()} == {0: 5, 1: 5, 2: 9, 3: 10}
