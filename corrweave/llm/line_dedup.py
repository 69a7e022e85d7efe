"""Line deduplication by range-partitioned line hashes.

Lines become (128-bit hash of the key, document, position) and are range
partitioned and sorted by all of it, so a line that a third of all documents
share is cut over many partitions by document instead of landing in one. A
pass over each sorted partition counts the documents of each run of one hash;
only what a partition's first and last run hold goes to the driver (a few
numbers for each partition), which joins the runs that cross a boundary. A
second pass over the same partitions (a reliable checkpoint keeps them and
their order) emits the positions that go. A pass holds one partition's hashes,
about `PARTITION_LINES`. The positions are folded to one compressed keep bitmap
for each document; a text meets its bitmap in one join.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased. Keys of at least `min_chars` code points in at least `min_docs`
documents are duplicates; `keep` says which of their lines stay: "none", or
"first" (the first by document id and position).

Defined cases: a null text is the empty text, one empty line; empty keys are
never duplicates; rows with the same doc_id and text are one document, which
counts once, and each such row is returned with the same result; rows with
the same doc_id and different texts are different documents; a null doc_id
sorts before all others; the lines of a very long text are rows like others
and its bitmap has a bit for each; an empty table gives an empty result; input
columns named like the results give way to them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, ascii_lower, cut, fresh, table

MIN_CHARS = 1
MIN_DOCS = 10
PARTITION_BYTES = 16 << 20
#: Lines of a partition of hashes, about.
PARTITION_LINES = 250_000

_COLS = ("h1", "h2", "d1", "d2", "pos")


def document_key(docs: DataFrame) -> list:
    """What tells documents apart: doc_id (null: the least long) and a hash of the text."""
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))),
        F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))),
    ]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key is long enough."""
    d1, d2 = document_key(docs)
    # The keys are columns before the lines are made: expressions beside the explode would be evaluated for each line.
    keyed = docs.select(d1.alias("d1"), d2.alias("d2"), ascii_lower(docs["text"].cast("string")).alias("text"))
    lines = keyed.select("d1", "d2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(WHITE))
    long = lines.select("d1", "d2", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "d1", "d2", "pos")


def _whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The partition's columns; it holds a bounded number of slim rows, as range keys are all different."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return [t.column(c).to_numpy() for c in _COLS]


def _runs(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of one hash, and for each run its number of documents."""
    h1, h2, d1, d2, _ = cols
    new_hash = np.concatenate([[True], (np.diff(h1) != 0) | (np.diff(h2) != 0)])
    new_doc = new_hash | np.concatenate([[True], (np.diff(d1) != 0) | (np.diff(d2) != 0)])
    starts = np.flatnonzero(new_hash)
    return starts, np.add.reduceat(new_doc.astype(np.int64), starts)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols = _whole(batches)
    if cols is None:
        return
    starts, n_docs = _runs(cols)
    h1, h2, d1, d2, _ = cols
    ends = [0, len(h1) - 1]
    first_end = (starts[1] if len(starts) > 1 else len(h1)) - 1
    last_start = starts[-1]
    row = [
        TaskContext.get().partitionId(), len(starts),
        *(int(x[i]) for i in ends for x in (h1, h2)), int(n_docs[0]), int(n_docs[-1]),
        *(int(x[i]) for i in (0, first_end, last_start, len(h1) - 1) for x in (d1, d2)),
    ]
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=[f"c{i}" for i in range(len(row))])


def join_runs(rows: list[tuple]) -> dict[int, tuple[int, bool, int]]:
    """Partition -> (documents of its first run's hash everywhere, whether that run began before, documents of its last run's hash).

    `rows` are the summaries; runs of one hash in neighbouring partitions are
    one run, and a document at the seam counts once.
    """
    rows = sorted(rows)
    total: dict[tuple, int] = {}
    seen: dict[int, bool] = {}
    last_hash, last_doc = None, None
    for pid, n_runs, fh1, fh2, lh1, lh2, n_first, n_last, *docs in rows:
        first, last = (fh1, fh2), (lh1, lh2)
        first_doc, end_doc = tuple(docs[0:2]), tuple(docs[6:8])
        seen[pid] = first == last_hash
        total[first] = total.get(first, 0) + n_first - (seen[pid] and first_doc == last_doc)
        if n_runs > 1:
            total[last] = total.get(last, 0) + n_last
        last_hash, last_doc = last, end_doc
    return {r[0]: (total[r[2:4]], seen[r[0]], total[r[4:6]]) for r in rows}


def dropped_lines(hashes: DataFrame, min_docs: int, keep: str, n_partitions: int) -> DataFrame:
    """(d1, d2, pos) of the lines that go."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    # Lines of repeated rows are combined where they are read, so that range keys are all different.
    # Without the cut, lines would be split and hashed once more for a sample of the ranges.
    hashes = cut(hashes.distinct())
    in_order = cut(hashes.repartitionByRange(n_partitions, *_COLS).sortWithinPartitions(*_COLS))
    summary = ", ".join(f"c{i} bigint" for i in range(16))
    seams = join_runs([tuple(r) for r in in_order.mapInArrow(_summary, summary).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = _whole(batches)
        if cols is None:
            return
        starts, n_docs = _runs(cols)
        first_total, began_before, last_total = seams[TaskContext.get().partitionId()]
        n_docs = n_docs.copy()
        n_docs[-1] = last_total
        n_docs[0] = first_total
        drop = np.repeat(n_docs >= min_docs, np.diff([*starts, len(cols[0])]))
        if keep == "first":
            drop[starts[1 if began_before else 0 :]] = False
        at = np.flatnonzero(drop)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            kinds = (pa.int64(), pa.int64(), pa.int32())
            arrays = [pa.array(c[part], k) for c, k in zip(cols[2:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["d1", "d2", "pos"])

    return in_order.mapInArrow(run, "d1 bigint, d2 bigint, pos int")


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Compressed keep bits up to the last line that goes; lines beyond it stay."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, dtype=bool)  # whole bytes, so that no padding reads as dropped
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def apply_bitmap(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """(text of the lines that stay, lines before, lines dropped)."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(keep == 0).tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and position; a document's rows may cross batches."""
    held: list[tuple[int, int, np.ndarray]] = []

    def emit(groups: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        cols = [pa.array([g[0] for g in groups], pa.int64()), pa.array([g[1] for g in groups], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([pack_bitmap(g[2]) for g in groups], pa.binary())], names=["d1", "d2", "keep_bitmap"])

    for b in batches:
        if not b.num_rows:
            continue
        d1, d2, pos = (b.column(i).to_numpy() for i in range(3))
        edges = [0, *(np.flatnonzero((np.diff(d1) != 0) | (np.diff(d2) != 0)) + 1), len(d1)]
        groups = [(int(d1[i]), int(d2[i]), pos[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        if held and held[0][:2] == groups[0][:2]:
            groups[0] = (*held[0][:2], np.concatenate([held[0][2], groups[0][2]]))
            held = []
        out, held = held + groups[:-1], groups[-1:]
        if out:
            yield emit(out)
    if held:
        yield emit(held)


def keep_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "none", partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """(d1, d2, keep_bitmap) for each document that loses a line; d1 and d2 as in `document_key`."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    n_lines = F.coalesce(F.sum(F.octet_length(text) - F.octet_length(F.translate(text, "\n", "")) + 1), F.lit(0))
    size, lines = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), n_lines).first()
    gone = dropped_lines(line_hashes(docs, min_chars), min_docs, keep, max(8, -(-size // partition_bytes), -(-lines // PARTITION_LINES)))
    return gone.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "pos").mapInArrow(_bitmaps, "d1 bigint, d2 bigint, keep_bitmap binary")


def drop_duplicate_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "none", partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """All rows and columns of `docs`, `text` without its duplicate lines, and `n_lines` and `n_dropped`."""
    docs = docs.drop("n_lines", "n_dropped")
    k1, k2, bits = fresh(docs, "_cw_d1", "_cw_d2", "_cw_bits")
    maps = keep_bitmaps(docs, min_chars, min_docs, keep, partition_bytes).toDF(k1, k2, bits)
    d1, d2 = document_key(docs)
    both = docs.withColumns({k1: d1, k2: d2}).join(maps, [k1, k2], "left").select(*[f"`{c}`" for c in docs.columns], bits)
    names, at = docs.columns, docs.columns.index("text")
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [apply_bitmap(t.as_py() or "", m.as_py()) for t, m in zip(b.column(at), b.column(len(names)), strict=True)]
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array([x[0] for x in got], pa.string())
            counts = [pa.array([x[i] for x in got], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*cols, *counts], names=out_names)

    return both.mapInArrow(run, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_duplicate_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT doc_id, line, pos, key IN (SELECT key FROM f) AS gone FROM k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
