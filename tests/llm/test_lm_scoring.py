import math
from collections import Counter

import fixtures as X
import numpy as np
import pytest

from corrweave.llm import lm_scoring as L


def counts(rows, order):
    grams = Counter()
    for doc_id, text, *_ in rows:
        if X.remainder(doc_id, 5) != 1:
            w = [b" ", *L.tokens(text), b"\n"]
            grams[(b" ",)] += 1
            for i in range(1, len(w)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        grams[tuple(w[i - n + 1 : i + 1])] += 1
    return grams


def expected(all_rows, order):
    grams = counts(all_rows, order)
    one = {g[0]: c for g, c in grams.items() if len(g) == 1 and g != (b" ",)}
    total, v = sum(one.values()), len(one)
    out = []
    for doc_id, text, *_ in all_rows:
        w = [x.encode() for x in X.words(X.lower(text))] + [b"\n"]
        base = sum(math.log10((one.get(x, 0) + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        out.append((doc_id, X.remainder(doc_id, 5) == 1, len(w), sum(x in one for x in w), total, round(base, 7), round(L.score_text(text, grams, total, v, order), 7)))
    return out


def got(df):
    return [(*tuple(r)[:5], round(r["base_score"], 7), round(r["score"], 7)) for r in df.collect()]


@pytest.mark.parametrize(("order", "radix", "lane"), [(1, 128, 2048), (2, 128, 2048), (2, 2, 3), (3, 3, 5), (4, 128, 1)])
def test_scores(spark, order, radix, lane):
    """Against the formula, token by token; small radices take several hops, small lanes cut texts into runs."""
    docs = X.documents(spark, block="clash", train=1, to=2)
    assert X.same(got(L.score_documents(docs, order=order, block_bytes=600, radix=radix, lane=lane)), expected(X.ROWS, order))


def test_query(spark, tmp_path):
    X.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    df = L.op6_lm_scoring(spark, str(tmp_path))
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert X.same(got(df), expected(X.ROWS, L.ORDER))


def test_equal_rows_and_very_long_texts(spark):
    many = [(5, "a b a c", "en", "a")] * 3000 + [(6, "b a " * 150_000 + "c", "en", "a"), (7, "b a c", "en", "a"), (11, "a b", "en", "a")]
    assert X.same(got(L.score_documents(X.documents(spark, many), order=2)), expected(many, 2))


def test_messages_are_in_proportion_to_blocks(spark):
    docs = X.documents(spark, [(i, f"word{i} and word{i % 7} " * 3, "en", "a") for i in range(600)])
    rows = {}
    for n in (20, 80):
        hops = L.Hops(n, radix=9)
        rows[n] = [m.count() for m in L.questions(L.blocks_of(docs, n), hops)]
        assert all(r <= 9 * hops.radix**hops.depth for r in rows[n])
    assert len(rows[20]) == len(rows[80]) == 2 and sum(rows[80]) <= 8.5 * sum(rows[20])


def test_automaton_follows_failure_arcs():
    """The automaton of a few n-grams by hand: an arc where the bigram was seen, else the failure arc's weight and the root's arc."""
    block = L.Block(["a b", "a c"], 2)
    totals, grams = [], []
    for level in range(2):
        keys, at = block.distinct(level)
        seen = np.bincount(at[: 3], minlength=len(keys))  # the first text is the training text
        totals.append(seen)
        grams.append((seen, at))
    m = L.Automaton(block, grams, 3, 3, 1, 10.0)
    unknown, known = 0.5 / 5, 1.5 / 5
    first = (1 + 10 * known) / 11
    by_hand = [first * (1 + 10 * known) / 11 * (1 + 10 * known) / 11, first * (10 / 11 * unknown) * known]
    assert m.score(block.starts, block.lengths) == pytest.approx(np.log10(by_hand))
    state, weight = m.step(np.array([L.START]), m.tokens[:1])
    assert state[0] > L.START and weight[0] == pytest.approx(math.log10(first))


def test_model_sums_to_one():
    grams = counts(X.ROWS, 2)
    one = {g[0]: c for g, c in grams.items() if len(g) == 1 and g != (b" ",)}
    total, v = sum(one.values()), len(one)
    uni = {w: (c + 0.5) / (total + 0.5 * (v + 1)) for w, c in one.items()}
    unknown = 0.5 / (total + 0.5 * (v + 1))
    assert sum(uni.values()) + unknown == pytest.approx(1)
    for h in [b" ", b"the", b"header", b"x"]:
        c = grams.get((h,), 0)
        p = [(grams.get((h, w), 0) + L.MASS * q) / (c + L.MASS) for w, q in uni.items()]
        assert sum(p) + L.MASS * unknown / (c + L.MASS) == pytest.approx(1)


def test_empty(spark):
    assert L.score_documents(X.documents(spark).filter("doc_id < 0")).count() == 0
    lone = [(3, "a b", "en", "a")] if X.remainder(3, 5) == 1 else [(next(i for i in range(99) if X.remainder(i, 5) == 1), "a b", "en", "a")]
    r = L.score_documents(X.documents(spark, lone)).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(0)


def test_better_than_unigrams_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.score_documents(docs).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.2 * sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.85 * len(rows)
