"""Similar pairs of any series by pivots and blocks of matrix products.

Series are vectors: centred and scaled to length one for Pearson's r, as they are
for Euclidean similarity. Both similarities fall with the vectors' distance, so a
bound on one is a bound D on the other: sqrt(2 - 2 r), or 1 / s - 1. Some vectors,
`PIVOTS` at most, are pivots, and every vector joins the block of its nearest one.
Blocks p and q hold no pair within D if their pivots lie further apart than D and
both blocks' radii (the triangle inequality), and are never brought together.
The others meet in one task for each two parts of at most about `PART_ROWS` vectors
(a block of more is dealt to several parts by hash), as one matrix product; pairs near the bound
are measured again in the order of the series, so that results don't depend on blocks.

Only pivots, radii and counts come to the driver: `PIVOTS` vectors, and two numbers for each block.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.session import Scratch, cut

log = logging.getLogger(__name__)

PIVOTS = 256
PART_ROWS = 1024
#: Pairs that are measured again at once.
CHUNK = 8192
#: What rounding may move a similarity or a distance by, relative to the vectors' lengths.
SLACK = 1e-9


def vectors(edges: DataFrame, measure: str) -> DataFrame:
    """(edge_id, v, len, s): what is compared. Pearson's r isn't defined for constant series, which go."""
    if measure == "euclidean":
        return edges.select("edge_id", F.col("series").alias("v"), F.lit(1.0).alias("len"), F.lit(0).cast("long").alias("s"))
    series = F.col("series") if measure == "pearson" else F.transform("series", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    alive = F.size(F.filter("series", lambda x: x > 0)).cast("long")
    return edges.select("edge_id", S.centred(series).alias("v"), alive.alias("s")).withColumn("len", S.norm(F.col("v"))).filter("len > 0").select("edge_id", "v", "len", "s")


def distance_bound(bound: float, measure: str) -> float:
    """The distance that pairs of similarity `bound` don't exceed."""
    if measure == "euclidean":
        return 1 / bound - 1 if bound > 0 else math.inf
    return math.sqrt(max(0.0, 2 - 2 * bound))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def exact(measure: str, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Similarities of rows of `a` with the same rows of `b`, each sum from the first snapshot to the last."""
    if measure == "euclidean":
        return 1 / (1 + np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1]))
    if measure == "pearson":
        return np.cumsum(a * b, axis=1)[:, -1] / (la * lb)
    n = a.shape[1]
    shared = ((a > 0) & (b > 0)).sum(axis=1)  # a centred 0/1 series is above 0 where it is alive
    return (n * shared - sa * sb) / np.sqrt(((n * sa - sa * sa) * (n * sb - sb * sb)).astype(np.float64))


def _pairs_of(bound: float, measure: str):
    limit = distance_bound(bound, measure)

    def run(batch: pa.Table) -> pa.Table:
        first = batch.column("first").to_numpy(zero_copy_only=False).astype(bool)
        ids, v, length, s = batch.column("edge_id").to_numpy(), _matrix(batch.column("v")), batch.column("len").to_numpy(), batch.column("s").to_numpy()
        same = bool(batch.column("same")[0].as_py())
        i, j = (np.flatnonzero(first), np.flatnonzero(first)) if same else (np.flatnonzero(first), np.flatnonzero(~first))
        a, b = (v[x] if measure == "euclidean" else v[x] / length[x, None] for x in (i, j))
        slack = SLACK * (1 + np.max((a * a).sum(axis=1), initial=0) + np.max((b * b).sum(axis=1), initial=0))
        near = _distances(a, b) ** 2 <= limit**2 + slack if len(a) and len(b) else np.zeros((len(a), len(b)), dtype=bool)
        if same:
            near &= ids[i][:, None] < ids[j][None, :]
        x, y = np.nonzero(near)
        out = []
        for k in range(0, len(x), CHUNK):
            p, q = i[x[k : k + CHUNK]], j[y[k : k + CHUNK]]
            p, q = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
            r = exact(measure, v[p], v[q], length[p], length[q], s[p], s[q])
            ok = r >= bound
            out.append((ids[p][ok], ids[q][ok], r[ok]))
        cols = [np.concatenate([o[c] for o in out]) if out else [] for c in range(3)]
        return pa.table({"e1": pa.array(cols[0], pa.int64()), "e2": pa.array(cols[1], pa.int64()), "r": pa.array(cols[2], pa.float64())})

    return run


@dataclass(frozen=True)
class Plan:
    """Blocks and parts of vectors: which meet, and the share of all pairs of vectors in blocks that don't."""

    blocks: DataFrame
    meetings: list[tuple[int, int, int]]
    parts: dict[int, int]
    skipped: float


def plan_blocks(edges: DataFrame, bound: float, measure: str, scratch: Scratch, pivots: int | None = None, part_rows: int = PART_ROWS) -> Plan:
    spark = edges.sparkSession
    vecs = scratch.keep(vectors(edges, measure))
    n = vecs.count()
    wanted = min(PIVOTS, pivots or max(1, round(math.sqrt(n) / 2)))
    unit = measure != "euclidean"
    chosen = vecs.orderBy(F.xxhash64("edge_id"), "edge_id").limit(wanted).select("v", "len").collect()
    centres = np.array([r["v"] for r in chosen], dtype=np.float64) if chosen else np.zeros((0, 0))
    if unit and len(chosen):
        centres /= np.array([r["len"] for r in chosen])[:, None]
    shared = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            if unit and len(v):
                v = v / b.column(2).to_numpy()[:, None]
            d = _distances(v, shared.value) if len(v) else np.zeros((0, 1))
            block = d.argmin(axis=1)
            cols = [*b.columns, pa.array(block, pa.int32()), pa.array(d[np.arange(len(d)), block], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["edge_id", "v", "len", "s", "block", "away"])

    placed = scratch.keep(vecs.mapInArrow(nearest, "edge_id bigint, v array<double>, len double, s bigint, block int, away double"))
    stats = {r[0]: (r[1], r[2]) for r in placed.groupBy("block").agg(F.count(F.lit(1)), F.max("away")).collect()}
    limit, apart = distance_bound(bound, measure), _distances(centres, centres)
    parts = {p: -(-size // part_rows) for p, (size, _) in stats.items()}
    meetings, skipped = [], 0
    for p in sorted(stats):
        for q in sorted(stats):
            if p <= q:
                if p == q or apart[p, q] * (1 - SLACK) - SLACK <= stats[p][1] + stats[q][1] + limit:
                    meetings += [(p, q, parts[q])] + ([(q, p, parts[p])] if p != q else [])
                else:
                    skipped += stats[p][0] * stats[q][0]
    total = n * (n - 1) // 2
    share = skipped / total if total else 0.0
    log.info("%s pairs: %d blocks, %.1f %% of the pairs of vectors lie in blocks that don't meet", measure, len(stats), 100 * share)
    sizes = spark.createDataFrame(list(parts.items()), "block int, parts int")
    dealt = placed.join(F.broadcast(sizes), "block").withColumn("part", F.pmod(F.xxhash64("edge_id"), F.col("parts")).cast("int"))
    return Plan(dealt, meetings, parts, share)


def close_pairs(edges: DataFrame, bound: float, measure: str = "pearson", pivots: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(e1, e2, r) with r >= `bound`; measure: "pearson", "euclidean", or "binary" (Pearson's r of 0/1 series by counts). A checkpoint."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "dense")
    plan = plan_blocks(edges, bound, measure, scratch, pivots, part_rows)
    met = spark.createDataFrame(plan.meetings, "block int, other int, other_parts int")
    copies = plan.blocks.join(F.broadcast(met), "block").withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    own, other = F.struct("block", "part"), F.struct(F.col("other").alias("block"), F.col("other_part").alias("part"))
    keyed = copies.select(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), (own <= other).alias("first"), (own == other).alias("same"), "edge_id", "v", "len", "s")
    out = cut(keyed.groupBy("lo", "hi").applyInArrow(_pairs_of(bound, measure), "e1 bigint, e2 bigint, r double"))
    scratch.clear()
    return out
