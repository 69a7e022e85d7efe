"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed byte trigrams of the whole text, with a few
style terms (shares of repeated words, capitals, symbols and repeated lines,
and the length, each in steps), damped, weighted by inverse document frequency
and projected on the leading singular vectors of a labelled sample. Labelled
vectors, at most `LABELLED_ROWS` of `RANK` numbers, are broadcast; every document
takes its cosine with all of them in blocked matrix products, and the labels
of its nearest neighbours vote with their similarity's power as weight.

The sample is the bounded part of the labelled, not held-out rows with the
least hash of their doc_id; the label, lang, source and doc_id are no inputs
of a score. Scoring is a map over the scan: no shuffle, no skew.

Defined cases: a null or empty text is scored by its style terms; a null
doc_id counts as the empty text for the held-out rows and has no label; a null
label is no label; of rows that share a labelled doc_id the least text is
learnt from; repeated rows score the same; without any label all score 1; an
empty table gives an empty result; further columns are ignored, or kept by
`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_kept, fresh, held_out_remainder, table

LABELLED_ROWS = 4096
DIMENSIONS = 2048
RANK = 64
NEIGHBOURS = 24
POWER = 4
CUT = 0.7
MODULUS, HELD_OUT = 4, 2
SEED = 10
BLOCK_ROWS = 512

_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])
_LENGTHS = np.array([10, 25, 50, 100, 200, 500, 2000, 10000])
_STYLES = 5
WIDTH = DIMENSIONS + _STYLES * (len(_STEPS) + 1)
#: Weight of a style term against a trigram that occurs once.
_STYLE_WEIGHT = 6.0

_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_LETTER[128:] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:128] = ~_LETTER[33:128]
_MARK[ord("0") : ord("9") + 1] = False
_MARK[[ord(c) for c in ".,'-"]] = False


def raw_features(text: str | None) -> np.ndarray:
    """Damped counts of one whole text."""
    data = (text or "").encode(errors="replace")
    out = np.zeros(WIDTH, dtype=np.float32)
    a = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    gram = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) if len(a) > 2 else a[:0]
    out[:DIMENSIONS] = np.log1p(np.bincount(gram >> np.uint32(21), minlength=DIMENSIONS))
    counts = np.bincount(a, minlength=256)
    letters = max(1, int(counts[_LETTER].sum()))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [
        1 - len(set(words)) / max(1, len(words)),
        counts[_UPPER].sum() / letters,
        counts[_MARK].sum() / letters,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    steps = [int(np.searchsorted(_STEPS, s)) for s in shares] + [int(np.searchsorted(_LENGTHS, len(words)))]
    for k, step in enumerate(steps):
        out[DIMENSIONS + k * (len(_STEPS) + 1) + step] = _STYLE_WEIGHT
    return out


class Voter:
    """The broadcast part: weights, projection, labelled vectors and labels."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray, rank: int = RANK):
        n = len(raw)
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + n) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 1
        x = self._weighted(raw)
        rng = np.random.default_rng(SEED)
        rank = min(rank, n, raw.shape[1])
        q = np.linalg.qr(x.T @ rng.standard_normal((n, rank + 16)).astype(np.float32))[0]
        for _ in range(4):  # subspace iteration towards the leading right singular vectors
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ vt.T[:, :rank]).astype(np.float32)
        self.vectors = self._unit(x @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _weighted(self, raw: np.ndarray) -> np.ndarray:
        return self._unit(raw * self.idf)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        """Votes of the nearest neighbours, between 0 and 1."""
        near = self._unit(self._weighted(raw) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 1e-6).astype(np.float64) ** POWER
        return np.clip((weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [raw_features(t.as_py()).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(raw, pa.binary())], names=["doc_id", "quality", "raw"])


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> Voter | None:
    """The voter of at most `most` labelled rows that aren't held out; None without any."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (held_out_remainder(F.col("doc_id"), MODULUS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id").limit(most)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = joined.select("doc_id", "text", "quality").mapInArrow(_features_of, "doc_id bigint, quality int, raw binary").collect()  # `most` rows
    if not got:
        return None
    got.sort(key=lambda r: r[0])
    raw = np.stack([np.frombuffer(r[2], dtype=np.float32) for r in got])
    return Voter(raw, np.array([r[1] for r in got]))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """All rows and columns of `docs` with `quality_score`."""
    docs = docs.drop("quality_score")
    voter = fit(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    names, at = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        model = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(i, BLOCK_ROWS)
                if model is None:
                    score = np.ones(b.num_rows)
                else:
                    score = model.scores(np.stack([raw_features(t.as_py()) for t in b.column(at)]))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(score)], names=[*names, "quality_score"])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of `docs`, all columns, that score at least `cut`."""
    (own,) = fresh(docs, "_cw_quality")
    held = docs.withColumnRenamed("quality_score", own) if "quality_score" in docs.columns else docs
    good = score_quality(held, labels).filter(F.col("quality_score") >= cut).drop("quality_score")
    return good.withColumnRenamed(own, "quality_score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        (held_out_remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT).cast("int").alias("predicted"),
    )
