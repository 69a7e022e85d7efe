import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.operators import existence, reach, setjoin
from corrweave.operators.peel import Candidate, Rules
from corrweave.sources import edits
from corrweave.sources import graph as G


def bfs(links, source, allowed):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hops, todo = {source: 0}, deque([source])
    while todo:
        u = todo.popleft()
        for v in near.get(u, ()):
            if v not in hops and (allowed is None or v in allowed):
                hops[v] = hops[u] + 1
                todo.append(v)
    return hops


def test_hops(spark):
    rnd = random.Random(4)
    links = [tuple(rnd.sample(range(30), 2)) for _ in range(36)] + [(40 + i, 41 + i) for i in range(9)] + [(3, 3), (5, 4), (4, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    sources = [0, 7, 40, 99]
    src = spark.createDataFrame([(s,) for s in sources], "source long")
    for allowed in (None, set(range(0, 60, 2)) | {41}, set()):
        keep = None if allowed is None else spark.createDataFrame([(v,) for v in allowed], "node long")
        got = {(r["source"], r["node"]): r["hops"] for r in reach.reachable(df, src, keep).collect()}
        assert got == {(s, v): h for s in sources for v, h in bfs(links, s, allowed).items()}
    near = {(r["source"], r["node"]) for r in reach.reachable(df, src, max_hops=2).filter("hops > 0").collect()}
    assert near == {(s, v) for s in sources for v, h in bfs(links, s, None).items() if 0 < h <= 2}
    assert reach.reachable(df, src.filter("source < 0")).count() == 0
    assert {(r["node"], r["other"]) for r in reach.neighbours(df, spark.createDataFrame([(4,)], "node long")).collect()} >= {(5, 4)}


@pytest.fixture
def graph(spark):
    rows = [(0, 1, 2, 1, [1.0, 0.0]), (1, 2, 3, 5, [0.0, 1.0]), (2, 3, 3, 1, [1.0, 1.0])]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, label int, series array<double>")
    return edges.withColumn("support", S.support(F.col("series")))


def test_changes(spark, graph):
    rows = [
        (5, "label", 1, None, None, 9, None), (7, "label", 1, None, None, 8, None), (6, "label", 1, None, None, 7, None),
        (1, "series", 0, None, None, None, [0.0, 0.0]), (2, "series", 0, None, None, None, [1.0, 1.0]), (3, "series", 77, None, None, None, [1.0, 1.0]),
        (9, "add", None, 8, 9, None, [1.0, 0.0]), (8, "add", None, 4, 4, 6, [1.0, 1.0]), (8, "add", None, None, 4, 6, [1.0, 1.0]),
        (4, "series", 2, None, None, None, None), (4, "label", None, None, None, 3, None), (4, "unknown", 2, None, None, 3, [0.0, 0.0]),
        (1, "node", None, 3, None, 30, None), (2, "node", None, 3, None, 33, None),
    ]
    changes = spark.createDataFrame(rows, edits.CHANGES)
    got = {r["edge_id"]: (r["src"], r["dst"], r["label"], r["series"], r["support"]) for r in edits.apply_changes(graph, changes).collect()}
    assert got == {0: (1, 2, 1, [1, 1], 2), 1: (2, 3, 8, [0, 1], 1), 2: (3, 3, 1, [1, 1], 2), 3: (4, 4, 6, [1, 1], 2), 4: (8, 9, 1, [1, 0], 1)}
    inc = edits.apply_to_incidence(G.incidence(graph), graph, changes)
    assert sorted(map(tuple, inc.collect())) == sorted((n, e) for e, (a, b, *_) in got.items() for n in (a, b))
    nodes = spark.createDataFrame([(3, 300), (4, 400)], "node_id long, node_label long")
    assert {tuple(r) for r in edits.relabel_nodes(nodes, changes).collect()} == {(3, 33), (4, 400)}
    none = changes.filter("seq < 0")
    assert sorted(map(str, edits.apply_changes(graph, none).collect())) == sorted(map(str, graph.select("edge_id", "src", "dst", "label", "series", "support").collect()))
    start = edits.apply_changes(graph.filter("edge_id < 0"), changes).collect()
    assert sorted(r["edge_id"] for r in start) == [0, 1]


def test_set_joins(spark):
    rnd = random.Random(0)
    a, b = ({",".join(map(str, x)): set(x) for x in (sorted(rnd.sample(range(25), rnd.randint(1, most))) for _ in range(n))} for n, most in ((120, 9), (80, 14)))
    left, right = (setjoin.named(spark.createDataFrame([(sorted(x, reverse=True),) for x in s.values()], "edges array<long>")).cache() for s in (a, b))
    jac = lambda x, y: len(x & y) / len(x | y)
    assert {(r["k1"], r["k2"]) for r in setjoin.contained_pairs(left, right).collect()} == {(x, y) for x in a for y in b if a[x] <= b[y]}
    assert {r["k"] for r in setjoin.not_contained(left, left, strict=True).collect()} == {x for x in a if not any(a[x] < a[y] for y in a)}
    assert {r["k"] for r in setjoin.not_contained(left, right).collect()} == {x for x in a if not any(a[x] <= b[y] for y in b)}
    for bound in (0.2, 0.5, 1.0):
        rows = setjoin.similar_pairs(left, bound=bound).collect()
        assert {(r["k1"], r["k2"]): r["jaccard"] for r in rows} == {(x, y): jac(a[x], a[y]) for x in a for y in a if x < y and jac(a[x], a[y]) >= bound}
        both = setjoin.similar_pairs(left, right, bound).collect()
        found = {(r["k1"], r["k2"]): r["jaccard"] for r in both}
        assert len(found) == len(both) and found == {(x, y): jac(a[x], b[y]) for x in a for y in b if jac(a[x], b[y]) >= bound}
    with pytest.raises(ValueError):
        setjoin.similar_pairs(left, bound=0.0)


def test_an_edge_in_all_sets_is_no_key(spark):
    """Every set holds edge 0: the index meets at the edges that are rare."""
    sets = setjoin.named(spark.range(4000).select(F.array(F.lit(0).cast("long"), F.col("id") + 1, F.col("id") + 2).alias("edges")))
    a, b, _ = setjoin._parts(sets, sets)
    met = a.join(b, a["e"] == b["e2"]).count()
    assert met < 5 * 4000 and setjoin.contained_pairs(sets, sets).count() == 4000 and setjoin.similar_pairs(sets, bound=0.5).count() == 3999


@pytest.mark.parametrize(("density", "k", "delta"), [("min", 1, 0.9), ("avg", 1, 1.1), ("avg", 2, 1.4)])
def test_bulk_peeling_is_the_greedy_test(spark, density, k, delta):
    from test_mining import random_graph, table

    ends, series, expected = {}, {}, {}
    for case in range(40):
        es, ss = random_graph(case, n_edges=10, n_nodes=7)
        if case % 5 == 0:
            es[0], ss[1] = (1, 1), [0] * 6  # a loop, and an edge that is never alive
        ids = [100 * case + e for e in es]
        ends |= {100 * case + e: v for e, v in es.items()}
        series |= {100 * case + e: s for e, s in ss.items()}
        c = Candidate(ids, [ends[e] for e in ids], [series[e] for e in ids], [sum(series[e]) for e in ids], Rules(delta, k, density))
        expected[",".join(map(str, sorted(ids)))] = c.contains_dense(delta)
    sets = spark.createDataFrame([([int(e) for e in ids.split(",")],) for ids in expected], "edges array<long>")
    got = {r["k"]: r["contains"] for r in existence.contains_dense(sets, table(spark, ends, series), k, delta, density).collect()}
    assert got == expected and set(expected.values()) == {True, False}
