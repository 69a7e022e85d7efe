"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives two records that point to it by `WARC-Refers-To`: a
`metadata` record (JSON: the source record's own WARC headers, its HTTP status
and headers, title and links) and a `conversion` record (its text). Both keep
the source's target URI and date, and name the source's payload digest beside
the digest of their own block. Record ids follow from what they name (page_id,
url and payload digest), so a task that runs again gives the same records.

`write_warc` writes them through Spark's text source with WARC's record ends as
line separators, `read_warc` reads files record by record (`warc_reader`), and
`responses_of` makes of what it has read the responses that `derive` takes.

Each page is handled where it is scanned: no shuffle, no skew.

Defined cases: a null URL or page is an empty one; a page without text has a
conversion record with an empty block; rows equal in page_id, url and page
name the same response and give the same records again, and any others have
ids of their own, also where page_id or url are null or repeated; repeated
header fields are all kept, in order; a page of any length or form takes time
in proportion to its length; an empty table gives no records; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .warc_reader import read_warc, responses_of  # noqa: F401

VERSION = "WARC/1.0"
#: `pages` don't say when they were fetched.
CAPTURE_DATE = "1970-01-01T00:00:00Z"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs

_UNSEEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_ENDS = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "title")} | {"": re.compile("-->")}
#: Elements that begin a line.
_BLOCKS = (
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split()
)
_BREAK = re.compile(rf"</?(?:{'|'.join(_BLOCKS)})\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-z/!?][^>]*>", re.I)
_TITLE = re.compile(r"<title\b", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_BARE = re.compile(r"""[^\s>"']+""")
_SPACE = re.compile("[ \\t\\r\\f\\v\\xa0]+")

RESPONSE_SCHEMA = "page_id long, record_id string, target_uri string, warc_date string, http_head string, payload string"
RECORD_SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, source_digest string, block string"
)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, '|'.join(map(str, names)))}>"


def without_unseen(html: str) -> str:
    """A page with a blank for each comment and script. What isn't closed stays, and is looked for once only, so the time is linear."""
    out, at, open_ended = [], 0, set()
    while m := _UNSEEN.search(html, at):
        kind = (m.group(1) or "").lower()
        end = None if kind in open_ended else _ENDS[kind].search(html, m.end())
        out.append(html[at : m.start()])
        if end:
            out.append(" ")
            at = end.end()
        else:
            open_ended.add(kind)
            out.append(m.group())
            at = m.end()
    return "".join([*out, html[at:]])


def _closed(html: str) -> int:
    """The end of the last tag: beyond it "<" opens none, so every search for a tag's end before it succeeds."""
    return html.rfind(">") + 1


def text_of(seen: str) -> str:
    """The text of a page without comments and scripts."""
    text = seen
    for tag, to in ((_BREAK, "\n"), (_TAG, "")):
        end = _closed(text)
        text = tag.sub(to, text[:end]) + text[end:]
    lines = (_SPACE.sub(" ", x).strip() for x in entities.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def plain_text(html: str) -> str:
    """Visible text: a line for each block element, entities resolved, runs of blanks joined."""
    return text_of(without_unseen(html))


def title_of(html: str) -> str:
    m = _TITLE.search(html)
    begin = html.find(">", m.end()) + 1 if m else 0
    end = _ENDS["title"].search(html, begin) if begin else None
    return plain_text(html[begin : end.start()]) if end else ""


def links_of(seen: str) -> list[str]:
    """The targets of a page's links, in order."""
    out = []
    for tag in _ANCHOR.finditer(seen[: _closed(seen)]):
        m = _HREF.search(seen, tag.start(), tag.end())
        if not m:
            continue
        quote = seen[m.end() : m.end() + 1]
        if quote in ("'", '"') and quote:
            end = seen.find(quote, m.end() + 1)
            if end >= 0:
                out.append(entities.unescape(seen[m.end() + 1 : end]))
        elif bare := _BARE.match(seen, m.end()):
            out.append(entities.unescape(bare.group()))
    return out


def _fields(head: str) -> list[list[str]]:
    """Header fields in their order, names and values; repeated ones each."""
    return [[k.strip(), v.strip()] for k, colon, v in (x.partition(":") for x in head.split("\r\n")) if colon]


def describe(source: dict, seen: str | None = None) -> str:
    """The block of a metadata record; seen: the page without comments and scripts, if that is known."""
    status, _, head = source["http_head"].partition("\r\n")
    html = source["payload"]
    seen = without_unseen(html) if seen is None else seen
    envelope = {
        "WARC-Header": {
            "WARC-Type": "response",
            "WARC-Record-ID": source["record_id"],
            "WARC-Target-URI": source["target_uri"],
            "WARC-Date": source["warc_date"],
            "WARC-Payload-Digest": digest(html.encode(errors="replace")),
        },
        "HTTP-Response": {"Status": status, "Headers": _fields(head), "Entity-Length": len(html.encode(errors="replace"))},
        "HTML": {"Title": title_of(html), "Links": links_of(seen)},
    }
    return json.dumps({"Envelope": envelope}, ensure_ascii=False, separators=(",", ":"))


def responses(pages: DataFrame, warc_date: str = CAPTURE_DATE) -> DataFrame:
    """Response records for pages that were stored without their WARC envelope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                html = html or ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode(errors='replace'))}"
                name = record_id("response", page_id, url or "", digest(html.encode(errors="replace")))
                rows.append((page_id, name, url or "", warc_date, head, html))
            yield _batch(rows, ["page_id", "record_id", "target_uri", "warc_date", "http_head", "payload"])

    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return slim.mapInArrow(run, RESPONSE_SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    whole = {"page_id": pa.int64(), "content_length": pa.int64()}
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, whole.get(n, pa.string())) for c, n in zip(cols, names, strict=True)], names=names)


def derive(found: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source in b.to_pylist():
                source = {k: ("" if v is None and k != "page_id" else v) for k, v in source.items()}
                of, seen = source["record_id"], without_unseen(source["payload"])
                source_digest = digest(source["payload"].encode(errors="replace"))
                for kind, content_type, block in (
                    ("metadata", "application/json", describe(source, seen)),
                    ("conversion", "text/plain; charset=utf-8", text_of(seen)),
                ):
                    data = block.encode(errors="replace")
                    own = record_id(kind, of)
                    rows.append((source["page_id"], kind, own, of, source["target_uri"], source["warc_date"], content_type, len(data), digest(data), source_digest, block))
            yield _batch(rows, names)

    return found.select(*[f.split()[0] for f in RESPONSE_SCHEMA.split(", ")]).mapInArrow(run, RECORD_SCHEMA)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Derived records as WARC files; `compression="gzip"` for .gz files."""
    head = {
        "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date",
        "WARC-Block-Digest": "block_digest", "WARC-Source-Payload-Digest": "source_digest", "Content-Type": "content_type", "Content-Length": "content_length",
    }
    fields = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in head.items()]
    whole = F.concat_ws("\r\n", F.lit(VERSION), *fields, F.lit(""), F.col("block"))
    records.select(whole.alias("value")).write.text(path, compression=compression, lineSep="\r\n\r\n")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))
