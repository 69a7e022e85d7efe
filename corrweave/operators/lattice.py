"""Classes of candidates, and their peel lattices as rows where they are large.

Most lattices are a few states, and the task that has the candidate peels them.
If one outgrows `Rules.states`, its queued states become rows (candidate, level,
bit mask) and go on as a frontier that all tasks share: level by level, states are
dealt by candidate and a salt that grows with the candidate's states, looked at
where they are, and their children come together by a distinct over all tasks. The
rule of shortcuts (see `peel`) is two anti-joins and a least parent for each
target. Only the level and whether rows are left come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.operators.peel import Candidate, Rules
from corrweave.session import Scratch, cut

SETS = "array<struct<edges: array<bigint>, density: double>>"
CLASSES = f"k string, cand array<bigint>, class string, sets {SETS}, left array<struct<level: int, mask: binary>>"
#: States of one candidate and level that one task looks at, about.
TASK_STATES = 2048

_SETS = pa.list_(pa.struct([("edges", pa.list_(pa.int64())), ("density", pa.float64())]))
_LEFT = pa.list_(pa.struct([("level", pa.int32()), ("mask", pa.binary())]))
_STATE = "k string, kind string, level int, mask binary, parent binary, edges array<bigint>, density double"


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def with_members(cands: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, m): each candidate by name with its edges' ends, series and supports."""
    keyed = cands.select(S.set_text(F.col("edges")).alias("k"), F.explode("edges").alias("edge_id"))
    full = keyed.join(edges.select("edge_id", "src", "dst", "series", "support"), "edge_id")
    return full.groupBy("k").agg(F.collect_list(F.struct("edge_id", "src", "dst", "series", "support")).alias("m"))


def _classes(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Candidate.of_members(m, rules)
                kind, sets, left = c.classify()
                rows.append((k, c.ids, kind, [{"edges": e, "density": d} for e, d in sets], [{"level": c.level(s), "mask": c.key(s)} for s in left]))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.string(), _SETS, _LEFT)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k", "cand", "class", "sets", "left"])

    return run


def _looks(rules: Rules, branch: bool):
    """Rows that states of one candidate lead to; with `branch`, children only, shortcut or not."""

    def run(states: pa.Table, blob: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        k = states.column("k")[0].as_py() if states.num_rows else None
        c = Candidate.of_members(blob.column("m")[0].as_py(), rules) if k is not None else None
        for mask in states.column("mask").to_pylist():
            state = int.from_bytes(mask, "big")
            x = c.look(state)
            if x.density is not None:
                rows.append((k, "dense", c.level(state), mask, None, c.named(state), x.density))
            elif x.rest and not branch:
                rows.append((k, "rest", c.level(x.rest), c.key(x.rest), mask, None, None))
            else:
                rows += [(k, "child", c.level(s), c.key(s), None, None, None) for s in c.children(state, x.low)]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64())
        names = ["k", "kind", "level", "mask", "parent", "edges", "density"]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def _look_at(states: DataFrame, members: DataFrame, rules: Rules, branch: bool = False) -> DataFrame:
    """`_looks` of states (k, mask): a candidate's states are dealt to as many tasks as they are many.

    The number of tasks is stated, as states are few bytes and much work: partitions would be merged by their bytes.
    """
    tasks = _tasks(states.sparkSession)
    salts = states.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / TASK_STATES).cast("int").alias("salts"))
    dealt = states.join(salts, "k").select("k", "mask", F.pmod(F.xxhash64("mask"), F.col("salts")).cast("int").alias("salt"))
    blobs = members.join(salts, "k").select("k", "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt, blobs = dealt.repartition(tasks, "k", "salt"), blobs.repartition(tasks, "k", "salt")
    return dealt.groupBy("k", "salt").cogroup(blobs.groupBy("k", "salt")).applyInArrow(_looks(rules, branch), _STATE)


def frontier(states: DataFrame, members: DataFrame, rules: Rules) -> DataFrame:
    """(k, edges, density) of the dense states below queued states (k, level, mask) of candidates (k, m); a checkpoint."""
    scratch = Scratch(states.sparkSession, "lattice")
    queued = scratch.keep(states.select("k", "level", "mask").distinct())
    found: DataFrame | None = None
    while True:
        level = queued.agg(F.max("level")).first()[0]
        if level is None or level < 2:
            break
        lower = queued.filter(F.col("level") < level)
        looked = scratch.keep(_look_at(queued.filter(F.col("level") == level).select("k", "mask"), members, rules))
        dense = looked.filter(F.col("kind") == "dense").select("k", "edges", "density")
        found = dense if found is None else found.union(dense)
        children = looked.filter(F.col("kind") == "child").select("k", "level", "mask")
        rests = looked.filter(F.col("kind") == "rest").select("k", "level", "mask", "parent")
        known = lower.union(children)
        taken = scratch.keep(rests.join(known.select("k", "mask"), ["k", "mask"], "left_anti").groupBy("k", "level", "mask").agg(F.min("parent").alias("parent")))
        others = rests.join(taken.select("k", "parent"), ["k", "parent"], "left_anti").select("k", F.col("parent").alias("mask"))
        more = _look_at(others, members, rules, branch=True).select("k", "level", "mask")
        queued = scratch.keep(known.union(taken.select("k", "level", "mask")).union(more).distinct())
    none = members.sparkSession.createDataFrame([], "k string, edges array<bigint>, density double")
    out = cut(found if found is not None else none)
    scratch.clear()
    return out


def classify(cands: DataFrame, edges: DataFrame, rules: Rules) -> DataFrame:
    """(cand, class, sets) of each candidate: "direct" with itself, "extracted" with its dense parts, or "pruned" with none.

    Candidates are dealt to a fixed number of tasks by hash, and each task takes its largest first. The result is a checkpoint.
    """
    members = with_members(cands, edges)
    dealt = members.repartition(_tasks(cands.sparkSession), F.xxhash64("k")).sortWithinPartitions(F.size("m").desc(), "k")
    looked = cut(dealt.mapInArrow(_classes(rules), CLASSES))
    opened = looked.filter(F.col("class") == "open")
    if opened.isEmpty():
        return looked.select("cand", "class", "sets")
    states = opened.select("k", F.explode("left").alias("s")).select("k", "s.level", "s.mask")
    found = frontier(states, cut(members.join(opened.select("k"), "k", "left_semi")), rules)
    more = found.groupBy("k").agg(F.collect_list(F.struct("edges", "density")).alias("more"))
    both = looked.join(more, "k", "left").withColumn("sets", F.concat("sets", F.coalesce("more", F.array().cast(SETS))))
    kind = F.when(F.col("class") != "open", F.col("class")).when(F.size("sets") > 0, "extracted").otherwise("pruned")
    return cut(both.select("cand", kind.alias("class"), "sets"))
