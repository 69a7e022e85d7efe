"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton, whose paths from the
root are the strings that occur in it. A text is parsed against each of them:
from left to right, a phrase is the longest match that begins where the last
phrase ended (or one byte that the language doesn't have). A text of m bytes
that takes c phrases against n bytes of a language costs c * log2(n) / m bits a
byte, the estimate of its cross entropy; the language of least cost wins.

Texts are lower-cased, and everything in ASCII that is no letter counts as one
blank between words. Longer texts than `WINDOW` bytes are parsed in windows of
so many bytes, all of them; the windows of a batch take their steps together, one
array operation for each byte of the longest, through dense tables of
transitions. Prediction is a map over the scan: no shuffle, no skew.

The automata are learnt from a bounded sample, spread over tasks by language:
the `SAMPLE_ROWS` rows of a language (not held out) with the least hash of
their doc_id, texts of at most `TEXT_BYTES` bytes first, and of these at most
`SAMPLE_BYTES` bytes a language, and `ALL_BYTES` over all languages. That bounds
what is broadcast: at most three transitions for each byte. Only a language
without shorter texts gives the first `TEXT_BYTES` characters of its texts.
Learning reads text and lang alone; prediction reads text alone.

Defined cases: a text that is null or has no letter is "und" with score 0; if
several languages cost the same, the least name wins; rows without doc_id, text
or lang aren't learnt from, nor are texts without a letter, and of rows that share
a learnt doc_id and lang the least text is learnt from; without any language all
are "und"; one language alone has score 1; an empty `lang` is a language like
others; repeated rows get equal results; very long texts are more windows; an
empty table gives an empty result; further columns are kept, and input columns
named like the results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out_remainder, table

SAMPLE_ROWS = 64
SAMPLE_BYTES = 32 << 10
ALL_BYTES = 256 << 10
TEXT_BYTES = 8 << 10
WINDOW = 2048
#: Bytes of texts whose windows take their steps together, about.
BLOCK_BYTES = 4 << 20
POWER = 8
MODULUS, HELD_OUT = 4, 2
SEED = 12
UNKNOWN = "und"

_PLAIN = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def normal(text: str) -> bytes:
    """Lower-cased UTF-8 with one blank for what is no letter in ASCII, and one at both ends."""
    return b" %b " % b" ".join(text.lower().encode(errors="replace").translate(_PLAIN).split())


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of each state by byte; state 0 is the root. Blumer et al.'s on-line construction."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = twin
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
        last = new
    return moves


@dataclass(frozen=True)
class Learnt:
    """A language's automaton as a list of transitions."""

    lang: str
    size: int
    states: np.ndarray
    chars: np.ndarray
    targets: np.ndarray


def learn(lang: str, texts: list[str], most: int = SAMPLE_BYTES) -> Learnt | None:
    """The automaton of the texts, up to `most` bytes in their order; matches don't cross texts. None without any letter."""
    pieces, left = [], most
    for text in texts:
        if left > 0 and has_letter(text):
            pieces.append(normal(text)[:left])
            left -= len(pieces[-1])
    if not pieces:
        return None
    moves = suffix_automaton(b"\0".join(pieces))
    flat = [(s, c, t) for s, m in enumerate(moves) for c, t in m.items() if c]
    states, chars, targets = (np.array(x, dtype=d) for x, d in zip(zip(*flat, strict=True), (np.int32, np.uint8, np.int32), strict=True))
    return Learnt(lang, sum(map(len, pieces)), states, chars, targets)


#: The two highest bits of a table entry: phrases that end with the step.
_COST = 30


class Model:
    """The automata of all languages, least name first, as one table of steps."""

    def __init__(self, learnt: list[Learnt]):
        self.learnt = sorted(learnt, key=lambda x: x.lang)
        self.langs = [x.lang for x in self.learnt]

    def __getstate__(self) -> dict:
        return {"learnt": self.learnt, "langs": self.langs}

    @cached_property
    def _steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each byte, the root of each language, and the table: place of the next state and phrases that end.

        A byte that a state doesn't take ends the phrase, and the next one begins with it;
        if the language doesn't have the byte, it is a phrase of its own.
        """
        used = np.unique(np.concatenate([x.chars for x in self.learnt]))
        kinds = np.zeros(256, dtype=np.uint32)
        kinds[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        roots, parts, base = [], [], 0
        for x in self.learnt:
            n_states = int(max(x.states.max(), x.targets.max())) + 1
            places = (base + np.arange(n_states, dtype=np.uint32)) * np.uint32(width)
            restart = np.full(width, places[0] | np.uint32(2 << _COST), dtype=np.uint32)
            first = x.states == 0
            restart[kinds[x.chars[first]]] = places[x.targets[first]] | np.uint32(1 << _COST)
            steps = np.tile(restart, (n_states, 1))
            steps[0] = places[0] | np.uint32(1 << _COST)
            steps[x.states, kinds[x.chars]] = places[x.targets]
            roots.append(places[0])
            parts.append(steps.ravel())
            base += n_states
        return kinds, np.array(roots, dtype=np.uint32), np.concatenate(parts)

    def phrases(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """(languages, texts): phrases of each text against each language."""
        kinds, roots, table_ = self._steps
        out = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        n_windows = -(-sizes // window)
        owner = np.repeat(np.arange(len(texts)), n_windows)
        if not len(owner):
            return out
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        lengths = np.minimum(window, sizes[owner] - nth * window)
        order = np.argsort(-lengths, kind="stable")
        owner, lengths = owner[order], lengths[order]
        starts = (np.repeat(np.cumsum(sizes) - sizes, n_windows) + nth * window)[order]
        data = kinds[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        at = np.repeat(roots[:, None], len(owner), axis=1)
        ended = np.zeros(at.shape, dtype=np.uint32)
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        for j, k in enumerate(alive.tolist()):
            step = table_.take(at[:, :k] + data[starts[:k] + j])
            ended[:, :k] += step >> np.uint32(_COST)
            np.bitwise_and(step, np.uint32((1 << _COST) - 1), out=at[:, :k])
        ended += at != roots[:, None]  # a phrase that the end of the window ends
        np.add.at(out, (slice(None), owner), ended)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and a score from 0 to 1."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        entropy = np.log2([max(2, x.size) for x in self.learnt])
        for i, j in _blocks([len(texts[k]) for k in known]):
            at = known[i:j]
            bits = self.phrases([normal(texts[k]) for k in at]) * entropy[:, None]
            best = bits.argmin(axis=0)
            for k, b in zip(at, best.tolist(), strict=True):
                langs[k] = self.langs[b]
            scores[at] = 1 / ((bits.min(axis=0) / bits) ** POWER).sum(axis=0)
        return langs, scores


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_BYTES."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= BLOCK_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


_LEARNT = "lang string, size bigint, states binary, chars binary, targets binary"


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, all_bytes: int = ALL_BYTES) -> Model:
    """The model of the languages in `docs`, of a bounded sample of the rows that aren't held out."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    size = F.octet_length("text")
    known = own.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (size > 0) & F.col("text").rlike("\\p{L}"))
    known = known.filter(held_out_remainder(F.col("doc_id"), MODULUS) != HELD_OUT)
    order = Window.partitionBy("lang").orderBy("long", "h", "doc_id")
    slim = known.select("lang", "doc_id", (size > TEXT_BYTES).alias("long"), F.xxhash64(F.lit(SEED), F.col("doc_id")).alias("h"))
    # Spark keeps the first rows of each language within each task already, so that no task sorts all of a language.
    sample = slim.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample_rows).groupBy("lang", "doc_id").agg(F.min("nth").alias("nth"))
    texts = known.join(F.broadcast(sample), ["lang", "doc_id"]).groupBy("lang", "doc_id", "nth").agg(F.min("text").alias("text"))
    texts = texts.select("lang", "nth", "doc_id", F.when(size > TEXT_BYTES, F.substring("text", 1, TEXT_BYTES)).otherwise(F.col("text")).alias("text"))
    n_langs = sample.select("lang").distinct().count()
    most = max(1, min(sample_bytes, all_bytes // max(1, n_langs)))

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("nth", "doc_id", "text")), strict=True))
        x = learn(group.column("lang")[0].as_py(), [r[2] for r in rows], most)
        got = [] if x is None else [(x.lang, x.size, x.states.tobytes(), x.chars.tobytes(), x.targets.tobytes())]
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays(cols, names=["lang", "size", "states", "chars", "targets"])

    found = texts.groupBy("lang").applyInArrow(run, _LEARNT).collect()  # `all_bytes` bound it
    return Model([Learnt(r[0], r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.uint8), np.frombuffer(r[4], np.int32)) for r in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of `docs` with `lang_pred` and `score`."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (held_out_remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
