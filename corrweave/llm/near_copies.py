"""Near copies by SimHash, checked exactly, with an exact search for those that two bits miss.

Two texts are near copies if their five-word Jaccard similarity is at least
`THRESHOLD`; components of near copies are the groups. First each text's SimHash
fingerprint goes through the grid of `simhash`, and what it links (equal, or at
most two bits apart) is verified by the whole shingle sets. Near copies may
differ in more bits, so the pairs between different components of these links
are then found by prefix and positional filtering:

Put all shingles in one order. If the sets of a pair, the smaller of m and the
larger of n shingles, have a similarity of the threshold t, they share
need = ceil(t (m + n) / (1 + t)) shingles at least. So the first one that they
share, whatever the order is, stands among the first m - need + 1 of one and
n - need + 1 of the other, and a pair is a candidate only if some hash stands so
in both. As m >= t n, the first n - ceil(t n) + 1 of every set, its prefix, are
all that has to be looked at, and no pair is lost. Rare shingles come first: the
order is by (count of the hash's slot among `SLOTS`, hash), with counts over all
texts. The counts only make candidates few; any would give the same pairs.

Only distinct sets enter, so exact copies cost nothing. Each set also has the
parity of its shingles in each of 256 buckets: the bits in which two sets
differ are no more than the shingles that only one of them holds, of which a
pair may have m + n - 2 need. Candidates that pass this bound too are verified
by the whole sets.

Hashes that more than `CROWD` sets share form no pairs at first: `PIVOTS` sets
of each such crowd are verified against those of other components, and what is
linked becomes one component. Pairs within a component need no test, as only the components
count. Then the sets of a hash outside its largest component are paired with
all of its sets, so a crowd that has become one component costs its size times
the few that stand apart, and no pair of different components is left out. Texts stay where
they are read: only the sets of candidates move, and joins against the few
documents that are candidates, or that go, are broadcast if these have been
counted to be few.

Defined cases: A-Z count as a-z; fewer words than a shingle make one shingle of
all; texts without words (or null) are copies of each other; shingles are
compared by 64-bit hashes; a very long text has a prefix row for each fifth of
its shingles; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrweave.operators.components import representatives

from .common import cut, kept, small
from .simhash import fingerprint, keep_one, text_hash
from .simhash import links as grid_links

SHINGLE = 5
#: As a fraction, so that counts compare exactly.
THRESHOLD = (4, 5)
CROWD = 160
PIVOTS = 4
#: Slots of the table of counts, which only orders shingles, and the rows that it moves in.
SLOTS, SLICES = 1 << 20, 64
CHUNK = 1 << 19
PARTITION_ROWS = 250_000
#: Pairs that a task verifies, at least.
TASK_PAIRS = 2_000

_NUM, _DEN = THRESHOLD
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    """Hashes of words; the store starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str) -> np.ndarray:
    """The distinct shingles' hashes (int64), sorted."""
    words = text.encode(errors="replace").lower().split()  # of bytes: ASCII letters and ASCII white space
    w = np.fromiter(map(kept("words", _Words).__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(w))
    if not k:
        return np.empty(0, dtype=np.int64)
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h += w[i : i + n] * _FACTORS[i]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return np.unique((h ^ h >> np.uint64(31)).view(np.int64))


def prefix_length(n: int) -> int:
    return n - -(-_NUM * n // _DEN) + 1


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), docs["text"].cast("string").alias("text"))


def slots(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How many distinct sets of a task, summed over the tasks, hold a shingle of each slot: `SLOTS` numbers, whatever the size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, seen = np.zeros(SLOTS, dtype=np.int64), [], 0, set()
        for b in batches:
            for t in b.column(0):
                h = shingles(t.as_py() or "")
                s = xxhash.xxh64_intdigest(h)
                if len(h) and s not in seen:
                    seen.add(s)
                    held.append(slots(h))
                    size += len(h)
                if size > CHUNK:
                    counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
        if counts.any():
            parts = [zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def unpack(b: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts = unpack(part.as_py())
                total[k] = total[k] + counts if k in total else counts
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    parts = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "slice int, counts binary")
    out = np.zeros(SLOTS, dtype=np.int64)
    for k, b in parts.repartition("slice").coalesce(8).mapInArrow(add, "slice int, counts binary").collect():  # `SLICES` rows
        out[k * (SLOTS // SLICES) : (k + 1) * (SLOTS // SLICES)] = np.frombuffer(b, dtype="<u8")
    return out


#: Columns of a set's parities, and bits of each.
PARITY = [f"p{k}" for k in range(4)]
#: What a set brings along to a hash.
OWN = ["s", "n", "i", *PARITY]


def parities(h: np.ndarray) -> np.ndarray:
    odd = np.bincount(h & (64 * len(PARITY) - 1), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefixes(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, text_hash, s (hash of the set), n (its size), its parities, the text's SimHash fingerprint, and the prefix in order.

    A set that a task met before has no fingerprint and no prefix there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = shared.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            odd = []
            for t in b.column(2):
                text = t.as_py() or ""
                h = shingles(text)
                s = int(np.uint64(xxhash.xxh64_intdigest(h)).view(np.int64))
                fp = first = None
                if s not in seen:
                    fp = int(np.uint64(fingerprint(text)).view(np.int64))
                    first = h[np.lexsort((h, counts[slots(h)]))[: prefix_length(len(h))]]
                seen.add(s)
                odd.append(parities(h))
                for col, value in zip(out, (s, len(h), fp, first), strict=True):
                    col.append(value)
            bits = np.array(odd, dtype=np.int64).reshape(-1, len(PARITY)).T
            cols = [*(pa.array(c, pa.int64()) for c in out[:2]), *(pa.array(np.ascontiguousarray(c)) for c in bits), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "text_hash", "s", "n", *PARITY, "fp", "prefix"])

    kinds = ", ".join(f"{p} bigint" for p in PARITY)
    return _slim(docs).mapInArrow(run, f"doc_id bigint, text_hash bigint, s bigint, n bigint, {kinds}, fp bigint, prefix array<bigint>")


def shared_hashes(prints: DataFrame) -> DataFrame:
    """Distinct (h, s, n, i, k) of the prefix hashes that two sets or more have: a hash, a set and its size, the hash's place in it, and how many sets have it."""
    rows = prints.agg(F.coalesce(F.sum(F.size(F.coalesce("prefix", F.array().cast("array<bigint>")))), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # a bounded number of slim rows, but for one hash's own
        if not got:
            return
        t = pa.Table.from_batches(got)
        h, s, ni = (t.column(c).to_numpy() for c in ("h", "s", "ni"))
        del t, got
        order = np.lexsort((s, h))
        h, s, ni = h[order], s[order], ni[order]
        new = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(s) != 0)])
        h, s, ni = h[new], s[new], ni[new]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0]))
        sizes = np.diff([*starts, len(h)])
        k = np.repeat(sizes, sizes)
        at = np.flatnonzero(k > 1)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            cols = [h[part], s[part], ni[part] >> 32, ni[part] & 0xFFFFFFFF, k[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "s", "n", "i", "k"])

    one = prints.select("s", "n", F.posexplode("prefix").alias("i", "h")).select("h", "s", F.shiftleft("n", 32).bitwiseOR(F.col("i").cast("long")).alias("ni"))
    return cut(one.repartition(max(8, -(-rows // PARTITION_ROWS)), "h").mapInArrow(run, "h bigint, s bigint, n bigint, i bigint, k bigint"))


def verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of sets whose similarity is high enough, by the whole sets."""
    pairs = cut(pairs)
    count = pairs.count()
    if not count:
        return pairs
    tasks = max(24, -(-count // TASK_PAIRS))
    needed = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    first = prints.join(needed, "s").groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    first = cut(first.select(F.col("f.doc_id").alias("d1"), F.col("f.text_hash").alias("d2")))
    texts = _slim(docs).join(small(first), F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("text_hash") == F.col("d2")), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [shingles(t.as_py() or "") for t in b.column(0)]
            s = np.array([xxhash.xxh64_intdigest(x) for x in h], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([x.tobytes() for x in h], pa.binary())], names=["s", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.int64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both * _DEN >= (len(x) + len(y) - both) * _NUM)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    grams = cut(texts.mapInArrow(sets, "s bigint, grams binary").dropDuplicates(["s"]))
    both = pairs.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")
    return cut(both.coalesce(tasks).mapInArrow(run, "a bigint, b bigint"))


def _may_match(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether two sets can be similar enough if the first shingle that they share is the one whose places are given."""
    need = F.ceil((x("n") + y("n")) * _NUM / (_NUM + _DEN) - 1e-6)
    apart = reduce(lambda a, b: a + b, [F.bit_count(x(p).bitwiseXOR(y(p))) for p in PARITY])
    return (x("n") - x("i") >= need) & (y("n") - y("i") >= need) & (apart <= x("n") + y("n") - 2 * need)


def fingerprint_links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Verified pairs of sets whose fingerprints are equal or linked by the grid.

    The sets of one fingerprint are paired with the least of them, and the least ones stand for linked fingerprints.
    """
    fps = cut(prints.filter(F.col("fp").isNotNull()).select("fp", "s").distinct())
    least = fps.groupBy("fp").agg(F.min("s").alias("m"))
    same = fps.join(least, "fp").select(F.col("m").alias("a"), F.col("s").alias("b"))
    near = grid_links(least.select("fp")).join(least.toDF("a", "ma"), "a").join(least.toDF("b", "mb"), "b")
    pairs = same.union(near.select("ma", "mb")).filter("a <> b")
    return verified(docs, prints, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def pivot_links(docs: DataFrame, prints: DataFrame, big: DataFrame) -> DataFrame:
    """Verified pairs of `PIVOTS` sets of each crowded hash with the others that have it and stand in other components (c).

    The pivots come from one order for each seed that doesn't depend on the hash, so hashes of one crowd have the same ones.
    """
    pivot = big.groupBy("h").agg(*[F.min_by(F.struct(*OWN, "c"), F.struct(F.xxhash64(F.lit(seed), "s"), F.col("s"))).alias(f"p{seed}_") for seed in range(PIVOTS)])
    pivot = pivot.select("h", F.explode(F.array_distinct(F.array(*[f"p{seed}_" for seed in range(PIVOTS)]))).alias("p"))
    star = big.join(pivot, "h").filter((F.col("c") != F.col("p.c")) & _may_match(F.col, lambda k: F.col(f"p.{k}")))
    return verified(docs, prints, star.select(F.least("s", "p.s").alias("a"), F.greatest("s", "p.s").alias("b")).distinct())


def links(docs: DataFrame, prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct sets whose components are those of all pairs that are similar enough."""
    parity = prints.groupBy("s").agg(*[F.first(p).alias(p) for p in PARITY])

    def sets(found: DataFrame) -> DataFrame:
        """Each set with its parities and its component c by the pairs found so far."""
        of = representatives(found, found.count()).withColumnRenamed("node", "s")
        return cut(parity.join(of, "s", "left").select("s", *PARITY, F.coalesce("rep", "s").alias("c")))

    found = fingerprint_links(docs, prints)
    known = sets(found)
    members = shared_hashes(prints)
    crowded = members.filter(F.col("k") > crowd)
    if not crowded.isEmpty():
        more = pivot_links(docs, prints, cut(crowded.join(known, "s")))
        if not more.isEmpty():
            found = found.union(more)
            known = sets(found)
    c = cut(members.join(known, "s").select("h", *OWN, "c"))
    sizes = c.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"))
    tops = sizes.groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    apart = cut(c.join(tops, "h"))
    x, y = (apart.select(*[F.col(k).alias(f"{side}_{k}") for k in ("h", "c", "top", *OWN)]) for side in "xy")
    x = x.filter(F.col("x_c") != F.col("x_top"))
    once = (F.col("y_c") == F.col("y_top")) | (F.col("x_s") < F.col("y_s"))
    meet = (F.col("x_h") == F.col("y_h")) & (F.col("x_c") != F.col("y_c")) & once
    both = x.join(y, meet & _may_match(lambda k: F.col(f"x_{k}"), lambda k: F.col(f"y_{k}")))
    new = verified(docs, prints, both.select(F.least("x_s", "y_s").alias("a"), F.greatest("x_s", "y_s").alias("b")).distinct())
    return found.union(new)


def groups_of(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_hash and rep (one set of the component) of each row."""
    prints = cut(prefixes(docs, slot_counts(docs)))
    found = links(docs, prints, crowd)  # checkpoints, which are cheap to count
    rep = representatives(found, found.count())
    return prints.join(rep.withColumnRenamed("node", "s"), "s", "left").select("doc_id", "text_hash", F.coalesce("rep", "s").alias("rep"))


def drop_near_copies(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each component of near copies stays, told apart by doc_id and text, all columns."""
    return keep_one(docs, groups_of(docs, crowd))
