import random

import corpus_pipeline
import fixtures as X
import numpy as np
import pytest
import test_simhash as TS
import xxhash
from test_simhash import near_copies

from corrweave.llm import common, packing
from corrweave.llm import near_copies as N


def grams(text):
    w = X.words(X.lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return not a | b or 5 * len(a & b) >= 4 * len(a | b)


def survivors(rows):
    """By all pairs of texts."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    sets = [grams(d[2]) for d in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(None if d[0] else d[1], d[2]) for i, d in enumerate(docs) if root(i) == i]


def edited(n, seed, share):
    """Texts that differ from one of a few bases in runs of words, about the threshold."""
    rnd = random.Random(seed)
    bases = [[f"v{rnd.randint(0, 300)}" for _ in range(m)] for m in (6, 30, 120, 400)]
    out = []
    for i in range(n):
        own = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, max(1, int(len(own) * share / 5)))):
            own[rnd.randrange(len(own))] = f"edit{rnd.randint(0, 10**6)}"
        cut_at = rnd.randrange(len(own) // 8 + 1)
        out.append((2000 + i, " ".join(own[cut_at:]), "en", "a"))
    return out


def check(spark, rows, crowd):
    docs = X.documents(spark, rows, rep=1, s=2)
    got = N.drop_near_copies(docs, crowd)
    assert got.columns == docs.columns
    expected = survivors(rows)
    assert X.same([(r["doc_id"], r["text"] or "") for r in got.collect()], expected)
    return len(expected)


@pytest.mark.parametrize("crowd", [32, 3])
def test_against_all_pairs(spark, crowd):
    rows = [*X.ROWS, *near_copies(40), *edited(120, 1, 0.25)]
    assert check(spark, rows, crowd) < len(rows) - 60


def test_stage_drops_copies_beyond_two_bits(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(words[:370] + ["x"] * 3 + words[370:]), "en", "a"), (3, " ".join(words[:300]), "en", "a")]
    rows += [(4, " ".join([*words[:150], *(f"new{i}" for i in range(12)), *words[162:]]), "en", "a")]
    got = corpus_pipeline.drop_near_duplicates(spark, X.documents(spark, rows), "")
    assert {r["doc_id"] for r in got.collect()} == {d for d, _ in survivors(rows)} == {1, 3}


def test_empty(spark):
    assert N.drop_near_copies(X.documents(spark).filter("doc_id < 0")).count() == 0


def test_shingles_and_prefixes():
    for text in ("", " \n", "One two", "a b c d e", "a b c d e f a b c d e f a b c d e"):
        h = N.shingles(text)
        assert len(h) == len(grams(text)) and np.all(np.diff(h) > 0)
    assert N.shingles("A b\tc").tolist() == N.shingles("a B c").tolist()
    for n in range(1, 200):  # overlap ceil(0.8 n) can't avoid the prefix
        assert n - N.prefix_length(n) < -(-4 * n // 5)


def set_hash(text):
    return TS.signed(xxhash.xxh64_intdigest(N.shingles(text)))


def test_fingerprints_link_first(spark):
    """The grid's links, verified: pairs that aren't similar stay apart, and all groups of near copies within two bits are found."""
    far = [(1, "a a a", "en", "a"), (2, "a " * 10, "en", "a"), (3, "", "en", "a")]  # 1 and 2 have one fingerprint
    assert TS.plain_print(far[0][1]) == TS.plain_print(far[1][1])
    rows = [*far, *near_copies(40)]
    docs = X.documents(spark, rows)
    prints = N.cut(N.prefixes(docs, N.slot_counts(docs)))
    found = {(r["a"], r["b"]) for r in N.fingerprint_links(docs, prints).collect()}
    texts = {set_hash(r[1]): r[1] for r in rows}
    assert found and all(alike(grams(texts[a]), grams(texts[b])) for a, b in found)
    root = TS.groups({TS.plain_print(r[1]) for r in rows[3:]})
    groups = {}
    for r in rows[3:]:
        groups.setdefault(root[TS.plain_print(r[1])], set()).add(set_hash(r[1]))
    assert len(found) >= sum(len(g) - 1 for g in groups.values()) > 10
    assert all(any(a in g and b in g for g in groups.values()) for a, b in found)


def test_stage_goes_through_simhash(spark, monkeypatch):
    """Without the exact search, what is left are the groups of the fingerprints; with it, those of all pairs."""
    rows = near_copies(40)
    docs = X.documents(spark, rows)
    nothing = spark.createDataFrame([], "h long, s long, n long, i long, k long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1000}
    monkeypatch.setattr(N, "shared_hashes", lambda prints: nothing)
    root = TS.groups({TS.plain_print(r[1]) for r in rows})
    least = {}
    for r in sorted(rows, reverse=True):
        least[root[TS.plain_print(r[1])]] = r[0]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(least.values()) and 1 < len(got) < 30


def test_a_worker_keeps_the_store_of_one_operator(spark):
    """Stages share Python workers: the words and ids of packing don't stay beside the words of shingles or the classifier."""

    def classes(rows):
        return [type(v).__name__ for v in common._kept.values()]

    def run(batches):
        path = packing.public_tokenizers.path(packing.TOKENIZER)
        enc = packing.encoder(path)
        assert packing.encoder(path) is enc and classes(0) == ["WordEncoder"]
        N.shingles("a b c d e f")
        assert classes(0) == ["_Words"] and len(next(iter(common._kept.values()))) == 6
        assert packing.encoder(path) is not enc and classes(0) == ["WordEncoder"]
        common.drop_kept()
        assert classes(0) == []
        yield from batches

    assert spark.range(1, numPartitions=1).mapInArrow(run, "id long").count() == 1
