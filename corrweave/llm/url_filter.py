"""URL filters over a memory-mapped sorted digest array.

All listed strings (rules as host + path prefix, blocked hosts, and blocked
words of hosts) become one file: 64-bit XXH64 keys in ascending order, the
strings themselves, and an action for each. Executors get the file through Spark's own file distribution
and memory-map it, so every Python worker of a machine shares one copy of its
pages. A URL's candidate strings (its host and parent domains, alone and with
the path cut to each length a listed string has) are probed together by one
vectorised binary search; a key that matches counts only if the stored string
is equal, so digest collisions change nothing. Strings longer than the longest
listed one are not candidates, so a host of very many labels costs no more than
its length.

The lists are parameters that the user owns (also as tables of one column), not
something gathered from the corpus; the words of `BLOCKED_WORDS` are a general
default. Pages are judged where they are scanned: no shuffle, no skew.

Defined cases: a null URL, or one without `://`, has an empty host and path,
fits no rule and is allowed; repeated rows are judged one by one; an empty
table gives an empty result; an empty list allows everything; further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, shared_dir, table

ALLOW, BLOCK, LISTED = 0, 1, 2
#: Begins listed words; no host holds it.
_WORD = "~"
#: (host, path prefix, action); a rule holds for the host and all its subdomains, the longest wins.
RULES = [
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
]
# Words between dots and hyphens of a host that have it blocked where no rule fits (adult, gambling, drugs, advertising and fraud).
BLOCKED_WORDS = [
    "ads", "adserver", "adult", "banner", "bet", "bets", "betting", "bingo", "cams", "casino", "casinos", "cialis", "clickbait", "doubleclick", "escort", "escorts", "gambling",
    "hentai", "jackpot", "keygen", "lottery", "malware", "nude", "payday", "phishing", "pills", "poker", "popunder", "porn", "porno", "roulette", "sex", "slots", "spam", "viagra",
    "warez", "webcams", "xxx",
]

_LOWER = str.maketrans(UPPER, LOWER)
_PARTS = re.compile("[.-]")
_MAGIC = b"CWDIGEST"
_HEAD = 8 + 3 * 8


def build(entries: Iterable[tuple[str, int]]) -> bytes:
    """The file for (string, action) entries; a string given twice keeps its first action."""
    strings, actions = [], []
    for text, action in entries:
        strings.append(text.encode())
        actions.append(action)
    keys = np.fromiter(map(xxhash.xxh64_intdigest, strings), dtype="<u8", count=len(strings))
    order = sorted(np.argsort(keys, kind="stable").tolist(), key=lambda i: (keys[i], strings[i]))  # nearly sorted: only collisions and repeats move
    order = [i for k, i in enumerate(order) if not k or strings[i] != strings[order[k - 1]]]
    strings = [strings[i] for i in order]
    ends = np.cumsum([0, *map(len, strings)], dtype="<u8")
    lengths = sorted({len(s) - len(s.partition(b"/")[0]) if s.isascii() else len(s.decode()) - len(s.decode().partition("/")[0]) for s in strings})
    body = keys[order].tobytes() + ends.tobytes() + np.array(lengths, dtype="<u8").tobytes()
    body += bytes(actions[i] for i in order) + b"".join(strings)
    return _MAGIC + struct.pack("<3Q", len(strings), len(lengths), max(map(len, strings), default=0)) + body


class DigestArray:
    """A file of `build()`, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if bytes(raw[:8]) != _MAGIC:
            raise ValueError(f"{path} is not a digest array")
        n, m, self.longest = struct.unpack("<3Q", bytes(raw[8:_HEAD]))
        at = _HEAD
        self.keys = raw[at : (at := at + 8 * n)].view("<u8")
        self.ends = raw[at : (at := at + 8 * (n + 1))].view("<u8")
        self.path_lengths = raw[at : (at := at + 8 * m)].view("<u8").tolist()
        self.actions = raw[at : (at := at + n)]
        self.strings = raw[at:]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The place of each probe among the entries, -1 where it isn't one."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype="<u8", count=len(probes))
        at = np.searchsorted(self.keys, hashes)
        out = np.full(len(probes), -1, dtype=np.int64)
        n = len(self.keys)
        for i in np.flatnonzero((at < n) & (self.keys[np.minimum(at, n - 1)] == hashes)) if n else ():
            k = int(at[i])
            while k < n and self.keys[k] == hashes[i]:  # entries of one digest stand side by side
                if bytes(self.strings[int(self.ends[k]) : int(self.ends[k + 1])]) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out


def publish(spark: SparkSession, payload: bytes) -> str:
    """Write the file to the shared folder and have Spark hand it to every executor; returns its name."""
    name = f"digest-{hashlib.sha256(payload).hexdigest()[:24]}.bin"
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corrweave/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        # Under another name first, so that a driver that dies while writing leaves no broken file under this one.
        part = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corrweave/{name}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(payload)
        out.close()
        if not fs.rename(part, path) and not fs.exists(path):
            raise OSError(f"can't write {path}")
    sc.addFile(fs.makeQualified(path).toString())
    return name


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    i = url.find("://") if url else -1
    if i < 0:
        return "", ""
    rest = url[i + 3 :]
    cut = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_LOWER), slash + path


def judge(index: DigestArray, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each URL."""
    split = [split_url(u) for u in urls]
    probes: dict[str, int] = {}
    asked: list[list[int]] = []
    for host, path in split:
        mine = []
        at = len(host) + 1
        while at > 0 and len(host) - at < index.longest:  # domains from the shortest on; longer ones can't be listed
            at = host.rfind(".", 0, at - 1) + 1 if at > 1 else 0
            domain = host[at:]
            for n in index.path_lengths:
                if domain and n <= len(path) and len(domain) + n <= index.longest:
                    mine.append(probes.setdefault(domain + path[:n], len(probes)))
        for word in dict.fromkeys(_PARTS.split(host)):
            if len(word) < index.longest:
                mine.append(probes.setdefault(_WORD + word, len(probes)))
        asked.append(mine)
    strings = list(probes)
    found = index.find([s.encode(errors="surrogatepass") for s in strings])
    out = []
    for (host, path), mine in zip(split, asked, strict=True):
        hits = [(int(index.actions[found[k]]), strings[k]) for k in mine if found[k] >= 0]
        rule = max(((s, a) for a, s in hits if a != LISTED), key=lambda x: len(x[0]), default=None)
        if rule:
            out.append((host, path, rule[0], "block" if rule[1] == BLOCK else "allow"))
        else:
            out.append((host, path, None, "block" if hits else "allow"))
    return out


def _strings(listed: Iterable[str] | DataFrame) -> Iterable[str]:
    """The strings of a list, or of a table's first column (the user's list, which becomes one file), without nulls, A-Z lower-cased."""
    if isinstance(listed, DataFrame):
        listed = (r[0] for r in listed.select(listed[listed.columns[0]]).dropna().distinct().toLocalIterator())
    return (s.translate(_LOWER) for s in listed)


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, int]] = tuple(RULES),
    blocked_hosts: Iterable[str] | DataFrame = (),
    blocked_words: Iterable[str] | DataFrame = tuple(BLOCKED_WORDS),
) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of `pages`."""
    entries = itertools.chain(
        ((host + path, action) for host, path, action in rules),
        ((h, LISTED) for h in _strings(blocked_hosts)),
        ((_WORD + w, LISTED) for w in _strings(blocked_words)),
    )
    name = publish(pages.sparkSession, build(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for b in batches:
            got = judge(index, b.column(1).to_pylist())
            cols = [pa.array([x[k] for x in got], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["page_id", "host", "path", "rule", "verdict"])

    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    return slim.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{'block' if a == BLOCK else 'allow'}')" for h, p, a in RULES)}
), hit AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), [{", ".join(f"'{w}'" for w in BLOCKED_WORDS)}])
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN hit USING (page_id)
"""
