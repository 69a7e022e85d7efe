"""Divergence of the sources of each language, by K-squared quadtrees over the counts of terms.

The counts of a language are a matrix of groups (its sources) by kept terms, mostly
zeros. A quadtree cuts it into K by K quadrants, again and again, and keeps
one bit for each: a quadrant without a count isn't stored. Two blocks of groups
are compared by walking their trees together, one column range at a time: where
both quadrants are empty, every cell of theirs costs the same, a price known from
the groups' sizes alone, and so a whole quadrant is priced by its number of
columns; where one holds counts, both go on to their children, down to single
cells. Pairs of groups share the walk, as quadrants span groups.

Columns are dealt to stripes by hash, `STRIPE` counts each on average, groups to
blocks of about `BLOCK` by hash, and a task walks the trees of two blocks in one
stripe, so neither many terms nor many groups meet in one task: a walk holds one
chunk of quadrants for each level. Counting is combined in bounded dictionaries
before the only shuffle of terms. A frequent term or a large source is one row
for each task there. The ranks need the partners of one group, or for terms its
ten best of each task.

Terms are what remains of a text between ASCII characters that are no letters,
with A-Z lower-cased. A language keeps the terms of at least `min_docs` of its
documents. Shares are whole numbers, p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)),
and a term's divergence between two shares is floor((p - q)^2 / (p + q)); all of it is
exact below 9 * 10^15 counts a group.

Defined cases: null text, lang and source are ''; every row is a document, so
repeated rows count again; a group without terms, or a language without kept
ones (all values 0), is compared like any other; a language of one source has no
pairs; ties of value are ranked by the item's UTF-8 bytes; very long texts are
counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrweave.session import Scratch, cut

from .common import small, table

MIN_DOCS = 10
TOP = 10
K = 4
STRIPE = 200_000
BLOCK = 256
#: Distinct terms that a task counts before it passes them on.
HELD_TERMS = 300_000
#: Quadrants that are expanded at once.
CHUNK = 1 << 14
SCALE = 1_000_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, as far as they fit into HELD_TERMS."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            k = len(terms)
            cols = [pa.repeat(pa.scalar(x, pa.string()), k) for x in (lang, source)]
            counts = [pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            whole = pa.RecordBatch.from_arrays([*cols, terms, *counts], names=["lang", "source", "term", "n", "docs"])
            yield from (whole.slice(i, 50_000) for i in range(0, k, 50_000))
        held.clear()

    for b in batches:
        langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            words = terms_of(text.as_py())
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and rows with it."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    parts = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shares and divergences ---------------------------------------------------------------------------------------


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / total), exact."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), total.cast("decimal(19,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """`share` of arrays, by long division in steps of 1000; counts + 2 never exceed their total."""
    left, out = counts + 2, np.zeros(len(counts), dtype=np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // totals
        left %= totals
    return out + 1


# --- the quadtree -------------------------------------------------------------------------------------------------


class Quadtree:
    """Bits of the quadrants of a sparse matrix, level by level, and the index of the value of each set cell."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, height: int, k: int = K):
        """`rows`, `cols`: the set cells, each once, of a matrix of at most k^height rows and columns."""
        self.k, self.height = k, height
        code = np.zeros(len(rows), dtype=np.int64)
        for level in range(height):
            step = k ** (height - 1 - level)
            code = code * k * k + (rows // step % k) * k + cols // step % k
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        #: For each level, the child of each quadrant at each of its k * k places, or -1.
        self.child: list[np.ndarray] = []
        parents = np.zeros(min(1, len(code)), dtype=np.int64)
        for level in range(height):
            nodes = np.unique(code // (k * k) ** (height - 1 - level))
            bits = np.zeros(max(1, len(parents)) * k * k, dtype=bool)
            bits[np.searchsorted(parents, nodes // (k * k)) * k * k + nodes % (k * k)] = True
            self.child.append(np.where(bits, np.cumsum(bits) - 1, -1))
            parents = nodes

    def children(self, level: int, node: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The children of quadrants (-1: empty) at places; the cells' ranks at the last level."""
        return np.where(node < 0, -1, self.child[level][np.maximum(node, 0) * self.k * self.k + place])


def height_of(side: int, k: int = K) -> int:
    h = 1
    while k**h < side:
        h += 1
    return h


class Block:
    """Groups of one block with their counts in a stripe: a tree, the share of every count and the share of none."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, totals: np.ndarray, height: int, k: int):
        self.n_rows = len(totals)
        self.tree = Quadtree(rows, cols, height, k)
        at = self.tree.order
        self.shares = shares(counts[at], totals[rows[at]])
        self.none = shares(np.zeros(self.n_rows, dtype=np.int64), totals)


def joint_walk(a: Block, b: Block, n_cols: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(divergence over the columns, divergence of a column that neither has) of each group of `a` with each of `b`.

    With `same`, a and b are one block, and only pairs of a group with a later one are meant.
    """
    k, height = a.tree.k, a.tree.height
    value = np.zeros((a.n_rows, b.n_rows), dtype=np.int64)
    empty = [np.zeros((-(-a.n_rows // k ** (height - h)), -(-b.n_rows // k ** (height - h))), dtype=np.int64) for h in range(height + 1)]
    i, j, c = (x.ravel() for x in np.meshgrid(np.arange(k), np.arange(k), np.arange(k), indexing="ij"))
    root = np.zeros(1, dtype=np.int64)
    stack = [(0, root, root, root, root, root)] if n_cols else []
    while stack:
        level, node_a, node_b, row_a, row_b, col = stack.pop()
        if len(node_a) > CHUNK:
            stack += [(level, *(x[s : s + CHUNK] for x in (node_a, node_b, row_a, row_b, col))) for s in range(0, len(node_a), CHUNK)]
            continue
        side = k ** (height - level - 1)
        ra, rb, cc = ((x[:, None] * k + d).ravel() for x, d in ((row_a, i), (row_b, j), (col, c)))
        ok = (ra * side < a.n_rows) & (rb * side < b.n_rows) & (cc * side < n_cols)
        if same:
            ok &= ra <= rb
        parent = np.repeat(np.arange(len(node_a)), k**3)[ok]
        ra, rb, cc = ra[ok], rb[ok], cc[ok]
        ca = a.tree.children(level, node_a[parent], ra % k * k + cc % k)
        cb = b.tree.children(level, node_b[parent], rb % k * k + cc % k)
        none = (ca < 0) & (cb < 0)
        np.add.at(empty[level + 1], (ra[none], rb[none]), np.minimum(side, n_cols - cc[none] * side))
        ca, cb, ra, rb, cc = (x[~none] for x in (ca, cb, ra, rb, cc))
        if level + 1 < height:
            if len(ca):
                stack.append((level + 1, ca, cb, ra, rb, cc))
            continue
        p = np.where(ca < 0, a.none[ra], a.shares[np.maximum(ca, 0)] if len(a.shares) else 0)
        q = np.where(cb < 0, b.none[rb], b.shares[np.maximum(cb, 0)] if len(b.shares) else 0)
        np.add.at(value, (ra, rb), (p - q) ** 2 // (p + q))
    p, q = a.none[:, None], b.none[None, :]
    price = (p - q) ** 2 // (p + q)
    for h, columns in enumerate(empty):
        side = k ** (height - h)
        value += price * np.repeat(np.repeat(columns, side, axis=0)[: a.n_rows], side, axis=1)[:, : b.n_rows]
    return value, price


_WALKED = "lang string, a string, b string, value bigint, n_cols bigint, price bigint, v bigint"


def _walk(group: pa.Table, k: int) -> pa.Table:
    """The pairs of two blocks in one stripe. Rows without a term name the groups; `v` is the language's number of terms."""
    is_group = pc.is_null(group.column("term"))
    names, cells = group.filter(is_group), group.filter(pc.invert(is_group))
    lang, bi, bj, v = (group.column(c)[0].as_py() for c in ("lang", "bi", "bj", "v"))
    sources, blocks = names.column("source").to_pylist(), names.column("block").to_numpy()
    totals = names.column("total").to_numpy() + 2 * v
    out: list[tuple] = []
    if v:
        cell_rows = pc.index_in(cells.column("source"), value_set=pa.array(sources, pa.string())).to_numpy()
        terms = cells.column("term").combine_chunks().dictionary_encode()
        n_cols = len(terms.dictionary)
        cols = _similar_columns(terms.indices.to_numpy(), cell_rows, n_cols)
        counts = cells.column("n").to_numpy()
        height = height_of(max(n_cols, int((blocks == bi).sum()), int((blocks == bj).sum())), k)
        made = {}
        for block in {bi, bj}:
            members = np.flatnonzero(blocks == block)
            # Groups with many counts come first, so that the empty quadrants lie together.
            members = members[np.argsort(-np.bincount(cell_rows, minlength=len(sources))[members], kind="stable")]
            row = np.full(len(sources), -1, dtype=np.int64)
            row[members] = np.arange(len(members))
            own = row[cell_rows] >= 0
            made[block] = (members, Block(row[cell_rows[own]], cols[own], counts[own], totals[members], height, k))
        (ma, a), (mb, b) = made[bi], made[bj]
        value, price = joint_walk(a, b, n_cols, bi == bj)
    else:
        n_cols, ma, mb = 0, np.flatnonzero(blocks == bi), np.flatnonzero(blocks == bj)
        value = price = np.zeros((len(ma), len(mb)), dtype=np.int64)
    for x, y in np.ndindex(len(ma), len(mb)):
        if bi != bj or x < y:
            s, t = sorted((sources[ma[x]], sources[mb[y]]))
            out.append((lang, s, t, int(value[x, y]), n_cols, int(price[x, y]), v))
    kinds = (pa.string(),) * 3 + (pa.int64(),) * 4
    return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["lang", "a", "b", "value", "n_cols", "price", "v"])


def _similar_columns(cols: np.ndarray, rows: np.ndarray, n_cols: int) -> np.ndarray:
    """The columns renumbered, full ones first and those with counts of the same groups side by side."""
    marks = np.random.default_rng(11).integers(0, 1 << 62, int(rows.max(initial=0)) + 1, dtype=np.int64)
    pattern = np.zeros(n_cols, dtype=np.int64)
    np.add.at(pattern, cols, marks[rows])
    place = np.empty(n_cols, dtype=np.int64)
    place[np.lexsort((pattern, -np.bincount(cols, minlength=n_cols)))] = np.arange(n_cols)
    return place[cols]


# --- the audit ----------------------------------------------------------------------------------------------------


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, stripe: int = STRIPE, block: int = BLOCK, k: int = K) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of each group from the other sources of its language ("pair"), and its terms above the language's share ("term").

    The result is a checkpoint; tables between are written to the shared folder and removed.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    same_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(same_term), "lang_n": F.sum("n").over(same_term), "nth": F.row_number().over(same_term.orderBy("source"))})
    kept = scratch.keep(counted.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("nth") == 1).cast("long").alias("new")))
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("new").alias("new"), F.count(F.lit(1)).alias("cells"))
    groups = docs.select(name("lang"), name("source")).distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "new", "cells"])
    groups = scratch.keep(groups)
    sizes = groups.groupBy("lang").agg(F.sum("new").alias("v"), F.sum("total").alias("lang_total"), F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("n_groups"))
    count = lambda c, each: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(each))).cast("int")
    sizes = scratch.keep(sizes.select("lang", "v", "lang_total", count("cells", stripe).alias("stripes"), count("n_groups", block).alias("blocks")))

    # Pairs: every cell goes to the block pairs of its group in its term's stripe, every group to those of each stripe.
    dealt = {"block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}
    key = {"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}
    columns = ["lang", "stripe", "bi", "bj", "block", "source", "total", "v", "term", "n"]
    cells = kept.join(small(sizes), "lang").withColumn("stripe", F.pmod(F.xxhash64("term"), F.col("stripes")).cast("int")).withColumns(dealt).withColumns(key)
    cells = cells.withColumn("total", F.lit(None).cast("long")).select(*columns)
    named = groups.join(small(sizes), "lang").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).withColumns(dealt).withColumns(key)
    named = named.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(None).cast("long")}).select(*columns)
    walked = cells.unionByName(named).groupBy("lang", "stripe", "bi", "bj").applyInArrow(lambda t: _walk(t, k), _WALKED)
    summed = walked.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("n_cols").alias("n_cols"), F.max("price").alias("price"), F.max("v").alias("v"))
    # Columns of stripes in which neither block has a count are empty quadrants too.
    value = F.col("value") + (F.col("v") - F.col("n_cols")) * F.col("price")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = summed.select("lang", both.alias("x"), value.alias("value")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    sized = kept.join(small(groups.select("lang", "source", "total")), ["lang", "source"]).join(small(sizes.select("lang", "v", "lang_total")), "lang")
    p, q = share(F.col("n"), F.col("total") + 2 * F.col("v")), share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v"))
    over = sized.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = over.select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = cut(pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top)))
    scratch.clear()
    return out


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), w AS (
  SELECT id, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), n AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN n USING (lang, source) GROUP BY lang, source
), l AS (
  SELECT lang, sum(total) AS total FROM g GROUP BY lang
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (g.total + 2 * g.v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n.n) + 2)) // (any_value(l.total) + 2 * any_value(v.v)) AS q
  FROM n JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
