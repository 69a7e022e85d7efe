"""SimHash near-duplicates by a grid over segment popcounts.

A text's shingles vote on each of 64 bits. Fingerprints that differ in at most
two bits are linked, and components of links are the duplicate groups.

Search: the 32 two-bit segments of a fingerprint have popcounts 0 to 2, a
vector whose Manhattan distance never exceeds the number of differing bits.
Five groups of segments span a grid; a distance of at most two touches two
groups at most, so two linked fingerprints share the cell of at least one of
the ten projections on three groups. Pairs that meet in a cell are tested by
the Manhattan bound, then exactly. Nothing is lost by the grid.

Only distinct fingerprints enter it, so exact copies cost nothing. Cells of
more than `CROWD` fingerprints form no pairs: their members are linked through
the fingerprints at one bit's distance. Two fingerprints differ in at most two
bits exactly if both are equal to, or one bit from, some common one, and each
of these is shared by 65 at most. That is exact and linear in the size of the
crowd.

Defined cases: a text without words (or a null one) has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle of all;
repeated rows share fingerprint and component; a null doc_id never names a
component unless all its ids are null; an empty table gives an empty result;
further columns of the input are ignored by `components_of`, and kept by
`drop_near_copies`, where rows with the same doc_id and text are one document
and rows with the same doc_id (or none) and different texts are different ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.operators.components import representatives
from corrweave.session import cut

from .common import fresh, small, table

SHINGLE = 3
MAX_BITS = 2
SEED = 42
GROUPS = 5
CROWD = 16
_LOW = 0x5555555555555555


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """A bit is set if it is in over half the shingles' XXH64."""
    words = text.encode(errors="replace").lower().split()  # of bytes: ASCII letters and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    n = len(words) - k + 1
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=n)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):  # uint8 sums can't overflow within 255 rows
        bits = np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (a long with the fingerprint's bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", k) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), text_hash(docs).alias("text_hash"))
    return slim.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def popcounts(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each in its own two bits."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two vectors of `popcounts`: fields differ by 1 (01 or 11 in the xor) or by 2 (10)."""
    d = a.bitwiseXOR(b)
    odd = d.bitwiseAND(F.lit(_LOW))
    even = F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(_LOW)).bitwiseAND(F.bitwise_not(d))
    return F.bit_count(odd) + 2 * F.bit_count(even)


def projections() -> list[int]:
    """Masks of the grid's projections on three of its groups of segments."""
    groups = [reduce(lambda m, s: m | 3 << 2 * s, range(g * 32 // GROUPS, (g + 1) * 32 // GROUPS), 0) for g in range(GROUPS)]
    return [a | b | c for a, b, c in combinations(groups, GROUPS - MAX_BITS)]


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) whose components are those of all pairs within two bits."""
    v = popcounts(F.col("fp"))
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), v.bitwiseAND(F.lit(_signed(m))).alias("cell")) for p, m in enumerate(projections())]))
    placed = fps.select("fp", cells.alias("c")).select("fp", "c.p", "c.cell")
    shared = placed.groupBy("p", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(placed.join(shared, ["p", "cell"]))

    few = members.filter(F.col("n") <= CROWD).groupBy("p", "cell").agg(F.collect_list("fp").alias("l"))
    pairs = F.flatten(
        F.transform("l", lambda a, i: F.transform(F.slice(F.col("l"), i + 2, CROWD), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    close = F.filter(
        pairs,
        lambda x: (manhattan(popcounts(x["a"]), popcounts(x["b"])) <= MAX_BITS) & (F.bit_count(x["a"].bitwiseXOR(x["b"])) <= MAX_BITS),
    )
    sparse = few.select(F.explode(close).alias("x")).select("x.a", "x.b")

    crowd = members.filter(F.col("n") > CROWD).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    centres = crowd.select("fp", F.explode(around).alias("centre")).groupBy("centre").agg(F.collect_list("fp").alias("l"))
    stars = centres.filter(F.size("l") > 1).select(F.array_min("l").alias("a"), F.explode("l").alias("b")).filter("a <> b")
    return sparse.union(stars)


def _grouped(prints: DataFrame) -> DataFrame:
    """fp, least (its smallest doc_id) and rep (one fingerprint of its component) of each distinct fingerprint."""
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rep = representatives(links(fps.select("fp")))
    grouped = fps.join(rep.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("rep", "fp").alias("rep"))
    return cut(grouped)


def components_of(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of each row."""
    prints = cut(fingerprints(docs, k))
    grouped = _grouped(prints)
    ids = grouped.groupBy("rep").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(ids, "rep").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of `docs`, all columns, for each `rep` of `groups` (doc_id, text_hash, rep; one entry for each row of `docs` at least).

    It is the one with the smallest (doc_id, text hash), null ids last; a row
    goes only for another one of its group.
    """
    k1, k2 = fresh(docs, "_cw_doc_id", "_cw_text_hash")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = cut(groups.groupBy("rep", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("rep").agg(F.min(key).alias("f"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("rep", "f")
    gone = cut(rows.join(first, "rep").filter(key != F.col("f")).select(F.col("doc_id").alias(k1), F.col("text_hash").alias(k2)))
    d1, d2 = docs["doc_id"].cast("long"), text_hash(docs)
    left = docs.join(small(gone), d1.eqNullSafe(F.col(k1)) & (d2 == F.col(k2)), "left_anti")
    # Texts move once more only if some row came twice.
    if rows.filter("n > 1").isEmpty():
        return left
    return left.withColumns({k1: d1, k2: d2}).dropDuplicates([k1, k2]).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row of each component stays, told apart by doc_id and text, all columns."""
    prints = cut(fingerprints(docs, k))
    rep = _grouped(prints).select("fp", "rep")
    return keep_one(docs, prints.join(rep, "fp").select("doc_id", "text_hash", "rep"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
