"""Benchmark decontamination by size-partitioned MinHash containment (DataFrame functions only).

An item is contained in a document if at least `THRESHOLD` of its distinct
five-word shingles occur there. Document size says nothing about that, so only
the items get MinHash signatures, and these are sized by the items: items are
partitioned by the power of two of their shingle count, and the signature of a
partition is the k least hashes, k = hi - ceil(THRESHOLD * hi) + 1 for its
largest size hi. A document with the threshold's share of an item lacks fewer
than k of its shingles, so it holds at least one of the signature: candidates
are the documents with any hash of a signature, and none is lost. Candidates
are then verified by the exact shingles.

The hashes of a document, of all lengths that items need, are made and probed
in one scan. Candidate pairs are slim and checkpointed. Signatures and pairs
are broadcast only if their counted rows stay within `BROADCAST_ROWS`; beyond
it the joins shuffle. So texts are read a second time for candidates, where
they lie, and don't move as long as candidates are few.

Defined cases: A-Z count as a-z; an item of fewer than five words is one
shingle of all its words, searched with that many words; an item without words
(or null) is in no document; a null text holds nothing; repeated rows of
documents or items give one pair; rows that share a doc_id are each searched,
and the pair has the largest share; an empty table on either side gives no
pairs; a very long text is hashed whole, as one array of 8 bytes a word;
further columns are ignored, or kept by `drop_contaminated`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, ascii_lower, cut, fresh, small, table, words

SHINGLE = 5
#: As a fraction, so that counts compare exactly.
THRESHOLD = (4, 5)


def _hashes(w: Column, s: int) -> Column:
    """Hashes of all shingles of s words."""
    return F.when(
        F.size(w) >= s,
        F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: F.xxhash64(F.lit(s), *[F.get(w, i + k) for k in range(s)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _shingles(w: Column, s: int) -> Column:
    """The distinct shingles of s words, as text."""
    return F.when(
        F.size(w) >= s,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - s + 1), lambda i: F.array_join(F.slice(w, i, s), " "))),
    ).otherwise(F.array().cast("array<string>"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, s (words of a shingle), n (distinct shingles), grams and signature of each item with words."""
    w = words(ascii_lower(benchmark["text"].cast("string")))
    base = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), w.alias("w")).filter(F.size("w") > 0)
    base = base.withColumn("s", F.least(F.size("w"), F.lit(SHINGLE))).dropDuplicates(["item_id", "w"])
    by_size = [
        base.filter(F.col("s") == s).select("item_id", "s", _shingles(F.col("w"), s).alias("grams"), F.array_sort(F.array_distinct(_hashes(F.col("w"), s))).alias("h"))
        for s in range(1, SHINGLE + 1)
    ]
    num, den = THRESHOLD
    hi = F.expr("shiftleft(2, length(bin(n)) - 1) - 1")  # the largest size of the partition
    k = hi - F.ceil(hi * num / den).cast("int") + 1
    sized = reduce(DataFrame.union, by_size).withColumn("n", F.size("grams"))
    return sized.withColumn("signature", F.slice("h", F.lit(1), F.greatest(k, F.lit(1)))).drop("h")


def _keys(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].cast("long"), F.xxhash64(F.lit(2), docs["text"].cast("string"))]


def _candidates(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Distinct (doc_id, text hash, item_id) with a hash of the signature in common."""
    signatures = items.select("item_id", F.explode("signature").alias("h"))
    if signatures.count() <= BROADCAST_ROWS:
        signatures = F.broadcast(signatures)
    d1, d2 = _keys(docs)
    w = docs.select(d1.alias("doc_id"), d2.alias("text_hash"), words(ascii_lower(docs["text"].cast("string"))).alias("w"))
    every = [_hashes(F.col("w"), s) for s in sizes]  # a hash covers the shingle's length
    hashed = w.select("doc_id", "text_hash", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("h"))
    return hashed.join(signatures, "h").select("doc_id", "text_hash", "item_id").distinct()


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_shingles and n_found of each item contained in a text."""
    items = items_of(benchmark)
    sizes = sorted(int(r[0]) for r in items.select("s").distinct().collect())  # five values at most
    if not sizes:
        sizes = [SHINGLE]
    pairs = small(cut(_candidates(docs, items, sizes)))
    d1, d2 = _keys(docs)
    texts = docs.select(d1.alias("d1"), d2.alias("d2"), docs["text"].cast("string").alias("text"))
    marked = texts.join(pairs, F.col("d1").eqNullSafe(F.col("doc_id")) & (F.col("d2") == F.col("text_hash")))
    w = words(ascii_lower(F.col("text")))
    both = marked.select("doc_id", "text_hash", "item_id", w.alias("w")).join(items.select("item_id", "s", "n", "grams"), "item_id")
    grams = reduce(lambda other, s: F.when(F.col("s") == s, _shingles(F.col("w"), s)).otherwise(other), sizes, F.array().cast("array<string>"))
    found = both.select("doc_id", "text_hash", "item_id", F.col("n").cast("long").alias("n_shingles"), F.size(F.array_intersect("grams", grams)).cast("long").alias("n_found"))
    num, den = THRESHOLD
    return found.filter(F.col("n_found") * den >= F.col("n_shingles") * num).distinct()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the shingles found, one row for each pair."""
    best = contained(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_found", "n_shingles")).alias("b"))
    return best.select(
        "doc_id", "item_id", "b.n_shingles", "b.n_found", (F.col("b.n_found") / F.col("b.n_shingles")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text contains no item."""
    k1, k2 = fresh(docs, "_cw_d1", "_cw_d2")
    bad = cut(contained(docs, benchmark).select(F.col("doc_id").alias(k1), F.col("text_hash").alias(k2)).distinct())
    d1, d2 = _keys(docs)
    return docs.join(small(bad), d1.eqNullSafe(F.col(k1)) & (d2 == F.col(k2)), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = f"""
WITH iw AS (
  SELECT item_id, w, least({SHINGLE}, len(w)) AS s FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark)
  WHERE len(w) > 0
), ig AS (
  SELECT DISTINCT item_id, s, array_to_string(list_slice(w, i, i + s - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM iw)
), n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), dg AS (
  SELECT DISTINCT doc_id, s, array_to_string(list_slice(w, i, i + s - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM dw, (SELECT DISTINCT s FROM iw))
), f AS (
  SELECT doc_id, item_id, count(*) AS found FROM dg JOIN ig USING (s, g) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(found AS BIGINT) AS n_found,
       CAST(found AS DOUBLE) / CAST(n AS DOUBLE) AS containment
FROM f JOIN n USING (item_id) WHERE found * {THRESHOLD[1]} >= n * {THRESHOLD[0]}
"""
