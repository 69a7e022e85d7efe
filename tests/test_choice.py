import random

import brute
import pytest
from pyspark.sql import functions as F
from test_mining import random_graph, table

from corrweave.operators import lattice, select
from corrweave.operators.peel import Candidate, Rules

SCHEMA = "cand array<long>, class string, sets array<struct<edges: array<long>, density: double>>"


def random_case(rnd, base):
    """Classified candidates over a few edges, so that many of them overlap, contain each other or tie."""
    n = rnd.randint(4, 12)
    cands = {tuple(sorted(rnd.sample(range(base, base + n), rnd.randint(1, n)))) for _ in range(rnd.randint(1, 9))}
    rows = []
    for c in sorted(cands):
        kind = rnd.choice(["direct", "extracted", "pruned"])
        parts = {tuple(sorted(rnd.sample(c, rnd.randint(1, len(c) - 1)))) for _ in range(rnd.randint(1, 3))} if len(c) > 1 else set()
        if kind == "extracted" and not parts:
            kind = "pruned"
        sets = [(list(c), 1.0)] if kind == "direct" else [(list(p), sum(p) / 100) for p in sorted(parts)] if kind == "extracted" else []
        rows.append((list(c), kind, sets))
    return rows


@pytest.mark.parametrize("max_jac", [0.25, 0.5, 1.0, 1.5])
def test_rounds_choose_what_one_after_the_other_chooses(spark, max_jac):
    rnd = random.Random(int(100 * max_jac))
    cases = [random_case(rnd, 1000 * i) for i in range(250)]  # of edges of their own: no case touches another
    df = spark.createDataFrame([r for rows in cases for r in rows], SCHEMA).repartition(5)
    got = sorted((r["edges"], r["density"], r["origin"]) for r in select.diverse(df, 11, max_jac).collect())
    assert got == sorted((e, d, kind) for rows in cases for e, d, kind in brute.choose(rows, 11, max_jac))


def test_one_result(spark):
    rnd = random.Random(3)
    seen = set()
    for i in range(12):
        rows = random_case(rnd, 0)
        if i % 3 == 0:
            rows = [r for r in rows if r[1] != "direct"]
        got = [(r["edges"], r["density"], r["origin"]) for r in select.diverse(spark.createDataFrame(rows, SCHEMA), 11, 0.0).collect()]
        assert got == brute.choose(rows, 11, 0.0)
        seen |= {g[2] for g in got}
    assert seen == {"direct", "extracted"}
    # A dense candidate that is part of what was extracted before isn't the first.
    rows = [([1, 2, 3, 4], "extracted", [([1, 2, 3], 2.0)]), ([2, 3], "direct", [([2, 3], 1.0)]), ([7], "direct", [([7], 1.0)])]
    assert [r["edges"] for r in select.diverse(spark.createDataFrame(rows, SCHEMA), 11, 0.0).collect()] == [[7]]


def test_a_crowd_is_decided_in_few_rounds(spark, monkeypatch):
    """Thousands of sets that all overlap: no task sees more than its share, and rounds stay few."""
    df = spark.range(3000).select(F.array(F.lit(0).cast("long"), F.col("id") + 1, F.col("id") + 2).alias("cand"), F.lit("direct").alias("class"))
    df = df.withColumn("sets", F.array(F.struct(F.col("cand").alias("edges"), F.lit(1.0).alias("density"))))
    rounds, count = [], select.Scratch.keep
    monkeypatch.setattr(select.Scratch, "keep", lambda self, *a: rounds.append(1) or count(self, *a))
    assert select.diverse(df, 40, 1.0).count() == 3000 and len(rounds) < 12


@pytest.mark.parametrize(("density", "k", "delta"), [("min", 1, 1.2), ("avg", 1, 1.3), ("avg", 2, 1.6)])
def test_frontiers_find_what_one_task_finds(spark, density, k, delta):
    rules = Rules(delta, k, density, prune=False, states=0)
    ends, series, expected = {}, {}, {}
    for case in range(40):
        es, ss = random_graph(case, n_edges=11, n_nodes=7)
        ids = [100 * case + e for e in es]
        ends |= {100 * case + e: v for e, v in es.items()}
        series |= {100 * case + e: s for e, s in ss.items()}
        c = Candidate(ids, [ends[e] for e in ids], [series[e] for e in ids], [sum(series[e]) for e in ids], rules)
        expected[tuple(ids)] = {tuple(s): d for s, d in c.extract_dense()}
        assert set(expected[tuple(ids)]) == {tuple(s) for s in brute.lattice(ids, ends, series, k, density, delta)}
    cands = spark.createDataFrame([(list(ids),) for ids in expected], "edges array<long>")
    edges = table(spark, ends, series)
    for budget in (0, 9):
        got = lattice.classify(cands, edges, Rules(delta, k, density, prune=False, states=budget)).collect()
        found = {tuple(sorted(r["cand"])): {tuple(s["edges"]): s["density"] for s in r["sets"]} for r in got}
        assert found == {tuple(sorted(ids)): d for ids, d in expected.items()}
        assert {r["class"] for r in got} <= {"direct", "extracted", "pruned"}


def test_states_of_one_candidate_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TASK_STATES", 4)
    ends = {i: (i, (i + 1) % 9) for i in range(9)}
    series = {i: [1, 1] for i in range(9)}
    members = lattice.with_members(spark.createDataFrame([(list(ends),)], "edges array<long>"), table(spark, ends, series)).cache()
    c = Candidate(list(ends), list(ends.values()), list(series.values()), [2] * 9, Rules(1.9, 1))
    states = c.children(c.whole, range(9))
    df = spark.createDataFrame([(members.first()["k"], c.key(s)) for s in states], "k string, mask binary")
    looked = lattice._look_at(df, members, c.rules)
    assert len(states) == 9 and looked.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_shortcuts_that_are_queued_already():
    """A level's state whose shortcut is queued branches; the result is that of states taken one after the other in the stated order."""
    for seed in range(150):
        ends, series = random_graph(seed, n_edges=8, n_nodes=8)
        for density, k, delta in (("min", 1, 1.1), ("avg", 1, 1.2)):
            ids = list(ends)
            c = Candidate(ids, [ends[e] for e in ids], [series[e] for e in ids], [sum(series[e]) for e in ids], Rules(delta, k, density))
            whole = c.peel([c.whole])[0]
            part, left = c.peel([c.whole], budget=3)
            rest = c.peel(left)[0]
            assert part | rest == whole and not set(part) & set(rest)
