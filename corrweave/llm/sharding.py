"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash (one exchange that carries the records once). Pass 2 takes each bucket on
its own, puts it into a canonical order, permutes it by a Fisher-Yates shuffle
seeded with (seed, bucket) and writes it out. Buckets laid end to end are a
seeded random order of all records; shard k is its k-th eighth, so the law is
`rows`: shard sizes differ by one at most, and a shard's slots have no gap.

Because a bucket is sorted before it is permuted, a task that runs again after
a lost executor gives every record the same place. The scatter hash covers all
columns, so copies under other doc_ids part; rows equal in every column cannot
be told apart and share a bucket, which is then shuffled in runs of a bounded
size, for which the order among equal rows makes no difference. Only one count
for each memory-sized bucket goes to the driver.

Defined cases: a null text has no bytes; null ids and repeated rows are placed
like any others; with fewer rows than shards some shards stay empty; an empty
table gives an empty result; input columns named `shard` or `slot` give way to
the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table, text_bytes

SHARDS = 8
SEED = 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 8


def _hashable(kind: T.DataType) -> bool:
    return not ("map<" in kind.simpleString() or "variant" in kind.simpleString())


def shuffle_to_shards(
    docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, size_col: str = "text"
) -> DataFrame:
    """All rows and columns of `docs`, with `shard` (int) and `slot` (long, from 0 in each shard)."""
    docs = docs.drop("shard", "slot")
    h, bucket = fresh(docs, "_cw_h", "_cw_bucket")
    _, size = text_bytes(docs, size_col)
    n_buckets = max(LEAST_BUCKETS, -(-size // bucket_bytes))
    keys = [F.col(f"`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)]
    scattered = docs.withColumn(h, F.xxhash64(F.lit(seed), *keys))
    scattered = scattered.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(h)), F.lit(n_buckets)).cast("int"))

    counts = np.zeros(n_buckets, dtype=np.int64)
    for b, c in scattered.groupBy(bucket).count().collect():  # one number for each memory-sized bucket
        counts[b] = c
    starts, total = np.concatenate([[0], np.cumsum(counts)[:-1]]), int(counts.sum())
    shard_starts = np.array([-(-k * total // n_shards) for k in range(n_shards)], dtype=np.int64)

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: dict[int, int] = {}
        rngs: dict[int, np.random.Generator] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held)
            b = held[0].column(len(names) + 1)[0].as_py()
            held.clear()
            order = np.arange(rows.num_rows)
            rngs.setdefault(b, np.random.default_rng([seed, b])).shuffle(order)  # Fisher-Yates
            place = starts[b] + at.get(b, 0) + np.arange(rows.num_rows)
            at[b] = at.get(b, 0) + rows.num_rows
            shard = np.searchsorted(shard_starts, place, side="right") - 1
            slot = place - shard_starts[shard]
            step = 1024
            for i in range(0, len(order), step):
                part = rows.take(pa.array(order[i : i + step])).combine_chunks()
                cols = [part.column(k).combine_chunks() for k in range(len(names))]
                cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
                extra = [pa.array(shard[i : i + step], pa.int32()), pa.array(slot[i : i + step], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *extra], names=out_names)

        size = 0
        for batch in batches:
            ids = batch.column(len(names) + 1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if held and (held[0].column(len(names) + 1)[0].as_py() != ids[i] or size > 4 * bucket_bytes):
                    yield from flush()
                    size = 0
                held.append(part)
                size += part.nbytes
        yield from flush()

    placed = scattered.repartitionById(n_buckets, F.col(bucket)).sortWithinPartitions(bucket, h)
    return placed.select(*[f"`{c}`" for c in names], h, bucket).mapInArrow(run, schema)


def write_shards(shards: DataFrame, path: str) -> None:
    """A folder for each shard; files and their rows are in slot order, as buckets are contiguous in it."""
    shards.write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_to_shards(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
