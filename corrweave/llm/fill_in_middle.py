"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most `FRAME_BYTES` bytes,
each with the units (lines), code points and bytes before it. The two cuts of a
text are unit numbers: binary search over the cumulative counts names the frame
of a cut, and only that frame is decompressed to find its place. Outputs, the
texts restored from them and their digests are streamed frame by frame in the
order in which their parts are wanted, so a worker holds one open frame besides
compressed ones, however long a text is.

`store_frames`, `fill_in_middle`, `restore` and `load_texts` are maps over rows:
no shuffle, no skew. The transformed text is again a table of frames;
`restore` reads that and the form alone.

Units are lines, `[^\\n]*\\n|[^\\n]+`. Four numbers h1 to h4 of a document come from
the sha256 of its seed and id. The prefix ends after the smaller of h1 % (n + 1)
and h2 % (n + 1) units and the middle after the larger; h3 decides by
`fim_rate`, and h4 by `spm_rate` between the forms psm and spm.

Defined cases: a null text is the empty text, and an empty text is plain, as is
one that holds a mark; a null doc_id counts as the empty text in the hash;
repeated rows give equal results; a text without a line break is one unit, whose
cuts are its ends; very long texts are more frames; an empty table gives an empty
result; further columns are kept, and input columns named like the results give
way to them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from .common import table

FRAME_BYTES = 64 << 10
LEVEL = 1
SEED = 7
FIM_RATE = 100
SPM_RATE = 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Every byte that isn't the first of its code point.
_INNER = bytes(range(0x80, 0xC0))


def n_chars(data: bytes) -> int:
    """Code points of a piece of UTF-8, counted by their first bytes."""
    return len(data) if data.isascii() else len(data.translate(None, _INNER))


@dataclass
class Frames:
    """A text as compressed frames, with the line breaks, code points and bytes before each frame and at the end."""

    data: list[bytes] = field(default_factory=list)
    units: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    sizes: list[int] = field(default_factory=lambda: [0])
    unfinished: bool = False

    def __post_init__(self) -> None:
        self._open: tuple[int, bytes] = (-1, b"")

    def add(self, piece: bytes, pack: Callable[[bytes], bytes]) -> None:
        self.data.append(pack(piece))
        self.units.append(self.units[-1] + piece.count(b"\n"))
        self.chars.append(self.chars[-1] + n_chars(piece))
        self.sizes.append(self.sizes[-1] + len(piece))
        self.unfinished = not piece.endswith(b"\n")

    @property
    def n_units(self) -> int:
        return self.units[-1] + self.unfinished

    def frame(self, i: int) -> bytes:
        """Frame i decompressed; the last one read stays open."""
        if self._open[0] != i:
            self._open = (i, _unpack(self.data[i]))
        return self._open[1]

    def place(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which the first `unit` units end; one frame is decompressed at most."""
        if unit <= 0:
            return 0, 0
        if unit > self.units[-1]:
            return self.sizes[-1], self.chars[-1]
        i = bisect_left(self.units, unit) - 1
        piece, at = self.frame(i), -1
        for _ in range(unit - self.units[i]):
            at = piece.index(b"\n", at + 1)
        return self.sizes[i] + at + 1, self.chars[i] + n_chars(piece[: at + 1])

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from `start` to `end`, piece by piece."""
        end = self.sizes[-1] if end is None else end
        i = max(0, bisect_right(self.sizes, start) - 1)
        while start < end:
            stop = min(end, self.sizes[i + 1])
            if stop > start:
                yield self.frame(i)[start - self.sizes[i] : stop - self.sizes[i]]
                start = stop
            i += 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """The first byte of `mark` at or after `start`, or -1; marks may cross frames."""
        tail, at = b"", start
        for piece in self.stream(start):
            seen = tail + piece
            if (k := seen.find(mark)) >= 0:
                return at - len(tail) + k
            at += len(piece)
            tail = seen[-(len(mark) - 1) :]
        return -1

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self.stream():
            digest.update(piece)
        return digest.hexdigest()


def _unpack(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def stored(pieces: Iterator[bytes], frame_bytes: int = FRAME_BYTES) -> Frames:
    """The bytes of `pieces` as frames; no more than a frame and a piece are held uncompressed."""
    pack, out, held = zstandard.ZstdCompressor(level=LEVEL).compress, Frames(), bytearray()
    for piece in pieces:
        held += piece
        while len(held) >= frame_bytes:
            out.add(bytes(held[:frame_bytes]), pack)
            del held[:frame_bytes]
    if held:
        out.add(bytes(held), pack)
    return out


def numbers(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


@dataclass(frozen=True)
class Cut:
    """A form and the ends of prefix and middle as (byte, code point); plain texts have none."""

    form: str
    first: tuple[int, int] = (0, 0)
    second: tuple[int, int] = (0, 0)


def choose(frames: Frames, doc_id: int | None, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> Cut:
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not frames.sizes[-1] or h3 % 100 >= fim_rate or any(frames.find(m) >= 0 for m in (PREFIX, SUFFIX, MIDDLE)):
        return Cut("plain")
    a, b = sorted((h1 % (frames.n_units + 1), h2 % (frames.n_units + 1)))
    return Cut("spm" if h4 % 100 < spm_rate else "psm", frames.place(a), frames.place(b))


def transformed(frames: Frames, cut: Cut) -> Iterator[bytes]:
    """The output of a text, piece by piece."""
    if cut.form == "plain":
        yield from frames.stream()
        return
    first, second = cut.first[0], cut.second[0]
    parts = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, frames.sizes[-1])}
    for mark in (PREFIX, SUFFIX, MIDDLE) if cut.form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield mark
        yield from frames.stream(*parts[mark])


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output of a form was made of, piece by piece."""
    if form == "plain":
        yield from output.stream()
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    at, parts = 0, {}
    for mark, following in zip(order, (*order[1:], None), strict=True):
        begin = at + len(mark)
        at = output.find(following, begin) if following else output.sizes[-1]
        parts[mark] = (begin, at)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*parts[mark])


# --- tables of frames ---------------------------------------------------------------------------------------------

_FRAME = pa.struct([("data", pa.binary()), ("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64())])
#: The frames of a text; each counts the line breaks, code points and bytes up to its own end.
_FRAMES = pa.struct([("unfinished", pa.bool_()), ("frames", pa.list_(_FRAME))])
FRAMES_TYPE = from_arrow_type(_FRAMES)


def to_row(x: Frames) -> dict:
    ends = zip(x.data, x.units[1:], x.chars[1:], x.sizes[1:], strict=True)
    return {"unfinished": x.unfinished, "frames": [{"data": d, "units": u, "chars": c, "bytes": s} for d, u, c, s in ends]}


def from_row(row: dict | None) -> Frames:
    if row is None:
        return Frames()
    got = row["frames"] or []
    return Frames([f["data"] for f in got], [0, *(f["units"] for f in got)], [0, *(f["chars"] for f in got)], [0, *(f["bytes"] for f in got)], bool(row["unfinished"]))


def _mapped(df: DataFrame, source: str, results: dict[str, tuple[T.DataType, pa.DataType]], one: Callable[[dict], tuple]) -> DataFrame:
    """Rows of `df` without `source` and columns named like the results, and `one` of (source, doc_id) as the result columns."""
    at, id_at = df.columns.index(source), df.columns.index("doc_id")
    gone = {source.lower(), *(r.lower() for r in results)}
    stay = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    schema = T.StructType([*(df.schema.fields[i] for i in stay), *(T.StructField(k, v[0]) for k, v in results.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ids = b.column(at), b.column(id_at)
            got = [one(values[i], ids[i].as_py()) for i in range(b.num_rows)]
            cols = [pa.array([g[k] for g in got], kind) for k, (_, kind) in enumerate(results.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), *cols], names=schema.names)

    return df.mapInArrow(run, schema)


_LONG, _TEXT, _STORED = (T.LongType(), pa.int64()), (T.StringType(), pa.string()), (FRAMES_TYPE, _FRAMES)


def store_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The rows of `docs` with `stored`, the frames of the text, in place of `text`."""

    def one(text: pa.Scalar, _: int | None) -> tuple:
        data = memoryview((text.as_py() or "").encode(errors="replace"))
        return (to_row(stored((bytes(data[i : i + frame_bytes]) for i in range(0, len(data), frame_bytes)), frame_bytes)),)

    return _mapped(docs, "text", {"stored": _STORED}, one)


def load_texts(stored_: DataFrame) -> DataFrame:
    """The reverse of `store_frames`: `text` in place of `stored`."""
    return _mapped(stored_, "stored", {"text": _TEXT}, lambda x, _: (b"".join(from_row(x.as_py()).stream()).decode(),))


def fill_in_middle(stored_: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Stored rows with the output as `stored`, and n (units), form, prefix_chars, middle_chars (null if plain) and output_sha256."""

    def one(x: pa.Scalar, doc_id: int | None) -> tuple:
        frames = from_row(x.as_py())
        cut = choose(frames, doc_id, seed, fim_rate, spm_rate)
        out = stored(transformed(frames, cut))
        lengths = (None, None) if cut.form == "plain" else (cut.first[1], cut.second[1] - cut.first[1])
        return frames.n_units, cut.form, *lengths, out.sha256(), to_row(out)

    results = {"n": _LONG, "form": _TEXT, "prefix_chars": _LONG, "middle_chars": _LONG, "output_sha256": _TEXT, "stored": _STORED}
    return _mapped(stored_, "stored", results, one)


def restore(outputs: DataFrame) -> DataFrame:
    """Rows of `fill_in_middle` with the original text as `stored`, and restored_sha256; made of the output and the form alone."""
    packed = outputs.withColumn("stored", F.struct(F.col("form").alias("form"), F.col("stored").alias("output")))

    def one(x: pa.Scalar, _: int | None) -> tuple:
        row = x.as_py()
        back = stored(restored(from_row(row["output"]), row["form"]))
        return back.sha256(), to_row(back)

    return _mapped(packed, "stored", {"restored_sha256": _TEXT, "stored": _STORED}, one)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = restore(fill_in_middle(store_frames(docs)))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), v AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM u
), w AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM v
), x AS (
  SELECT *, array_to_string(units[:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM w
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM x
"""
