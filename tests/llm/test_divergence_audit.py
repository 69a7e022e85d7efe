import random
import re
from collections import Counter, defaultdict

import duckdb
import fixtures as X
import numpy as np
import pytest

from corrweave.llm import divergence_audit as D

SF = "/root/testdata/sf0.01"


def brute(rows, min_docs=10, top=10):
    """By definition, over (lang, source, text)."""
    docs = [(lang or "", source or "", [X.lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, s, words in own:
            counts[s].update(w for w in words if in_docs[w] >= min_docs)
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[s]) for s in counts}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return out


def got(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("k", [2, 3, 4])
def test_walks_against_dense_matrices(k):
    rng = np.random.default_rng(k)
    for _ in range(25):
        n_a, n_b, n_cols = rng.integers(1, 9), rng.integers(1, 9), rng.integers(1, 70)
        dense = [(rng.integers(0, 9, (n, n_cols)) * (rng.random((n, n_cols)) < 0.15)).astype(np.int64) for n in (n_a, n_b)]
        totals = [m.sum(axis=1) + 2 * n_cols + rng.integers(0, 99, len(m)) for m in dense]
        height = D.height_of(max(n_a, n_b, n_cols), k)
        blocks = [D.Block(*np.nonzero(m), m[np.nonzero(m)], t, height, k) for m, t in zip(dense, totals, strict=True)]
        p, q = (D.shares(m.ravel(), np.repeat(t, n_cols)).reshape(m.shape) for m, t in zip(dense, totals, strict=True))
        cost = lambda x, y: ((x[:, None] - y[None]) ** 2 // (x[:, None] + y[None])).sum(axis=2)
        assert (D.joint_walk(*blocks, n_cols, False)[0] == cost(p, q)).all()
        upper = np.triu_indices(n_a)
        assert (D.joint_walk(blocks[0], blocks[0], n_cols, True)[0][upper] == cost(p, p)[upper]).all()


def test_empty_quadrants_are_not_visited(monkeypatch):
    rows, cols = np.arange(16), np.arange(16)
    block = D.Block(rows, cols, np.ones(16, dtype=np.int64), np.full(16, 1 << 20), D.height_of(1 << 18), 4)
    seen, children = [], D.Quadtree.children
    monkeypatch.setattr(D.Quadtree, "children", lambda self, level, node, place: seen.append(len(node)) or children(self, level, node, place))
    value, price = D.joint_walk(block, block, 1 << 18, True)
    assert sum(seen) < 20_000 and value[0, 1] == 2 * ((block.shares[0] - block.none[0]) ** 2 // (block.shares[0] + block.none[0])) and price[0, 1] == 0


def test_shares_are_exact():
    rnd = random.Random(4)
    counts = [rnd.randint(0, 10**15) for _ in range(200)] + [0, 5]
    totals = [c + 2 + rnd.randint(0, 10**15) for c in counts[:-1]] + [7]
    assert D.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(counts, totals, strict=True)]


def rows_of(seed, n=400, n_sources=7):
    rnd = random.Random(seed)
    words = ["Apple", "pear", "ÄPFEL", "äpfel", "nuß", "x", "Ω", "don't", "a1b", " ", "_under_", "end\x7fmark", "日本"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice([f"s{i}" for i in range(n_sources)] + [None]), " ".join(rnd.choices(words, weights=[30 / (i + 1) + 1 for i in range(len(words))], k=rnd.randint(0, 25)))) for _ in range(n)]
    return rows + [("fr", "only", "too few words to keep"), ("xx", "a", None), ("xx", "b", "1 2 3"), ("en", "s0", "pear " * 90_000), ("en", "ä", ""), ("en", "Z", None)]


@pytest.mark.parametrize(("stripe", "block", "k"), [(D.STRIPE, D.BLOCK, D.K), (40, 3, 2)])
def test_against_brute_force(spark, stripe, block, k):
    rows = rows_of(stripe % 7)
    docs = spark.createDataFrame([(i, t, lang, s, 1, "clash") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string").repartition(5)
    assert X.same(got(D.audit(docs, stripe=stripe, block=block, k=k)), brute(rows))


def test_flushes_change_nothing(spark, monkeypatch):
    rows = rows_of(9, n=150)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    monkeypatch.setattr(D, "HELD_TERMS", 0)
    assert X.same(got(D.audit(docs, min_docs=5, top=3)), brute(rows, 5, 3))
    assert D.audit(docs.filter("lang = 'none'")).count() == 0


def test_query(spark):
    found = got(D.op11_divergence_audit(spark, SF))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(D.ORACLE_SQL)
    assert rel.columns == ["lang", "source", "part", "item", "value", "rank"] and X.same(found, rel.fetchall())
    assert X.same(found, brute(con.sql("SELECT lang, source, text FROM documents").fetchall()))
