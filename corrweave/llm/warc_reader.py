"""Records of WARC files, cut by their Content-Length.

Files are read as lines through Spark's text source: any store, plain ones split,
.gz ones (of one or many members) streamed. Each task cuts its lines into pieces,
of which a new one begins at every line that could be the first of a record, and
after `PIECE_BYTES`. Where records begin is then told for each file by its slim
rows alone, the pieces' sizes and the heads of possible records: the first record
is at the file's start, and each next one where the last one's length says. So a
line within a block that looks like a record's first is none, wherever
splits fall. Last, pieces of a record come together, a row for each.

Defined cases: WARC/1.0 and 1.1 (and any other 1.x); header fields are all kept,
repeated ones too, in order and as written, and folded lines belong to the field
before; a field's name is told without case; line ends may lack the carriage
return; a record without a valid length reaches to the next possible record; after
a length that leads to no record (a damaged file), reading goes on at the next
possible one; a block that the file's end cuts short is `truncated`; an empty
block is empty; an empty file has no records. Blocks are bytes (`content`), and the
same as UTF-8 text (`block`) with replacement characters for other bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.session import Scratch, cut

PIECE_BYTES = 1 << 20
#: Bytes of a piece's beginning that are kept to read a head which a split has cut.
HEAD_BYTES = 64 << 10

_FIRST = re.compile(rb"WARC/1\.\d+\r?\n")
_PIECES = "file string, split bigint, seq bigint, size bigint, start boolean, head binary, data binary"
_NAMES = ["file", "split", "seq", "size", "start", "head", "data"]
_OWNERS = "file string, split bigint, seq bigint, record bigint"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, split, value) in their order as pieces."""
    at: tuple[str, int] | None = None
    held: list[bytes] = []
    size, seq, start = 0, 0, False

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, seq, start
        if held:
            data = b"".join(held)
            row = (at[0], at[1], seq, size, start, data[:HEAD_BYTES], data)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=_NAMES)
            seq += 1
        held, size, start = [], 0, False

    for b in batches:
        files, splits = b.column(0).to_pylist(), b.column(1).to_pylist()
        for file, split, line in zip(files, splits, b.column(2), strict=True):
            if (file, split) != at:
                yield from flush()
                at, seq = (file, split), 0
            line = line.as_py() + b"\n"
            first = line.startswith(b"WARC/1.") and _FIRST.fullmatch(line) is not None
            if first or size >= PIECE_BYTES:
                yield from flush()
                start = first
            held.append(line)
            size += len(line)
    yield from flush()


def parse_head(data: bytes) -> tuple[str, list[tuple[str, str]], int] | None:
    """(version, fields, bytes up to the block) of a record that begins with `data`; None if its head doesn't end there."""
    end = re.search(rb"\r?\n\r?\n", data)
    if end is None:
        return None
    lines = data[: end.start()].decode(errors="replace").replace("\r\n", "\n").split("\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip())
        else:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0].strip(), fields, end.end()


def content_length(fields: list[tuple[str, str]]) -> int | None:
    found = next((v for k, v in fields if k.lower() == "content-length"), "")
    return int(found) if found.isascii() and found.isdigit() else None


def _owners(file: pa.Table) -> pa.Table:
    """The record of each piece of a file, by its slim rows; pieces before the first record have none."""
    rows = sorted(zip(*(file.column(c).to_pylist() for c in ("split", "seq", "size", "start", "head")), strict=True))
    offsets, total = [], 0
    for r in rows:
        offsets.append(total)
        total += r[2]
    possible = {o: i for i, (o, r) in enumerate(zip(offsets, rows, strict=True)) if r[3]}
    ordered = sorted(possible)
    begins, o = [], 0
    while o < total:
        i = possible.get(o)
        if i is None:  # no record where one is due: on at the next possible one
            later = bisect_right(ordered, o)
            if later == len(ordered):
                break
            o = ordered[later]
            continue
        begins.append(o)
        head, j = rows[i][4], i + 1
        while (parsed := parse_head(head)) is None and j < len(rows) and len(head) < HEAD_BYTES:  # a split within the head
            head, j = head + rows[j][4], j + 1
        n = content_length(parsed[1]) if parsed else None
        o = o + 1 if n is None else _next(o + parsed[2] + n, possible)
    owner = [bisect_right(begins, x) - 1 for x in offsets]
    keep = [i for i, r in enumerate(owner) if r >= 0]
    cols = [[file.column("file")[0].as_py()] * len(keep), [rows[i][0] for i in keep], [rows[i][1] for i in keep], [owner[i] for i in keep]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "split", "seq", "record"])


def _next(end: int, possible: dict[int, int]) -> int:
    """The beginning of the record after a block: two line ends on, or with less between where that is one."""
    return next((end + gap for gap in (4, 2, 3, 1, 0) if end + gap in possible), end + 4)


_RECORD = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("record", T.LongType()), T.StructField("version", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("content", T.BinaryType()), T.StructField("truncated", T.BooleanType()),
])
_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _record(pieces: pa.Table) -> pa.Table:
    rows = sorted(zip(*(pieces.column(c).to_pylist() for c in ("split", "seq", "data")), strict=True))
    data = b"".join(r[2] for r in rows)
    version, fields, at = parse_head(data) or (data.split(b"\n")[0].decode(errors="replace").strip(), [], len(data))
    n = content_length(fields)
    content = data[at:].rstrip(b"\r\n") if n is None else data[at : at + n]
    row = (pieces.column("file")[0].as_py(), pieces.column("record")[0].as_py(), version, [{"name": k, "value": v} for k, v in fields], content, n is not None and len(content) < n)
    kinds = (pa.string(), pa.int64(), pa.string(), _FIELDS, pa.binary(), pa.bool_())
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=_RECORD.names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, record (its number in the file), version, fields (name, value), headers (a map; the first of a repeated field), content, block and truncated. A checkpoint."""
    scratch = Scratch(spark, "warc")
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.text(path, lineSep="\n").select(*where, F.col("value").cast("binary").alias("value"))
    pieces = scratch.keep(lines.mapInArrow(_pieces, _PIECES))
    owners = scratch.keep(pieces.select("file", "split", "seq", "size", "start", "head").groupBy("file").applyInArrow(_owners, _OWNERS))
    whole = pieces.select("file", "split", "seq", "data").join(owners, ["file", "split", "seq"]).groupBy("file", "record").applyInArrow(_record, _RECORD)
    names = F.array_distinct(F.transform("fields", lambda f: f["name"]))
    first = lambda k: F.filter("fields", lambda f: f["name"] == k)[0]["value"]
    headers = F.map_from_entries(F.transform(names, lambda k: F.struct(k, first(k))))
    out = cut(whole.select("file", "record", "version", "fields", headers.alias("headers"), "content", F.make_valid_utf8(F.col("content").cast("string")).alias("block"), "truncated"))
    scratch.clear()
    return out


def field(records: DataFrame, name: str) -> Column:
    """The first value of a header field, told without case; null without it."""
    return F.get(F.filter(records["fields"], lambda f: F.lower(f["name"]) == name.lower()), F.lit(0))["value"]


def responses_of(records: DataFrame) -> DataFrame:
    """The response records of `read_warc` as `warc.derive` takes them: HTTP head and payload parted; page_id is null."""
    found = records.filter(field(records, "WARC-Type") == "response")
    head = F.substring_index("block", "\r\n\r\n", 1)
    payload = F.substring("block", F.char_length(head) + 5, F.char_length("block"))
    return found.select(
        F.lit(None).cast("long").alias("page_id"), field(found, "WARC-Record-ID").alias("record_id"), field(found, "WARC-Target-URI").alias("target_uri"),
        field(found, "WARC-Date").alias("warc_date"), head.alias("http_head"), payload.alias("payload"),
    )
