import random

import fixtures as X
import xxhash

from corrweave.llm import simhash as S
from corrweave.operators.components import representatives


def plain_print(text):
    w = [x.encode() for x in X.words(X.lower(text))]
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def groups(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    order = sorted(values)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_copies(n=70):
    rnd = random.Random(3)
    words = [f"w{rnd.randint(0, 500)}" for _ in range(400)]
    out = []
    for i in range(n):
        own = list(words)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(400)] = f"edit{rnd.randint(0, 10**6)}"
        out.append((1000 + i, " ".join(own), "en", "hot"))
    return out


def test_components_and_stage(spark):
    rows = [*X.ROWS, *near_copies()]
    docs = X.documents(spark, rows, fp="clash", component_id=1, rep=2)
    prints = [(r[0], plain_print(r[1])) for r in rows]
    root = groups({p for _, p in prints})
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    expected = [(d, signed(p), least.get(root[p])) for d, p in prints]
    got = S.components_of(docs)
    assert X.same([tuple(r) for r in got.collect()], expected)
    assert len(set(least.values())) < len({p for _, p in prints})  # some links aren't between equal prints
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    best = {}
    for d, text, *_ in rows:
        best.setdefault(root[plain_print(text)], []).append((d is None, d or 0))
    ids = [r["doc_id"] for r in kept.collect()]
    assert X.same([(d,) for d in ids], [(None if min(b)[0] else min(b)[1],) for b in best.values()])


def test_query(spark, tmp_path):
    rows = [*X.ROWS, *near_copies(30), (30, "a " * 600_000, "en", "a"), (31, "A " * 900_000, "en", "a")]
    X.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = S.op9_simhash(spark, str(tmp_path))
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [(r[0], plain_print(r[1])) for r in rows]
    root = groups({p for _, p in prints})
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    assert X.same([tuple(r) for r in df.collect()], [(d, f"{p:016x}", least.get(root[p])) for d, p in prints])


def test_stage_drops_a_row_only_for_one_of_its_component(spark):
    import corpus_pipeline

    far = [" ".join(f"{name}{i}" for i in range(60)) for name in ("ant", "bee", "cow", "dog", "elk")]
    rows = [
        (None, far[0], "en", "a"), (None, far[1], "en", "a"), (None, far[1], "en", "a"),  # no ids, two texts
        (8, far[2], "en", "a"), (8, far[3], "en", "a"), (8, far[3], "en", "b"),  # one id, two texts
        (5, far[3], "en", "a"), (None, far[3], "en", "a"), (9, far[4], "en", "a"), (8, far[4].upper(), "en", "a"),
    ]
    docs = X.documents(spark, rows, _cw_doc_id=1)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert X.same([tuple(r)[:2] for r in got.collect()], [(None, far[0]), (None, far[1]), (8, far[2]), (5, far[3]), (8, far[4].upper())])


def test_fingerprints(spark):
    assert S.fingerprint("") == S.fingerprint(" \n") == 0
    assert S.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    for text in ("a b c d", "x " * 1000, X.ROWS[13][1], "É é"):
        assert S.fingerprint(text) == plain_print(text)
    assert S.components_of(X.documents(spark).filter("doc_id < 0")).count() == 0


def check_links(spark, prints):
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    reps = {r["node"]: r["rep"] for r in representatives(S.links(df)).collect()}
    plain, found = {}, {}
    for p, r in groups(prints).items():
        plain.setdefault(r, set()).add(p)
        found.setdefault(reps.get(signed(p), signed(p)), set()).add(p)
    assert sorted(map(sorted, plain.values())) == sorted(map(sorted, found.values()))


def test_links_of_crowds(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    crowd = set()
    for _ in range(300):
        x = base
        for _ in range(rnd.choice([1, 2, 3, 4])):
            x ^= 1 << rnd.randrange(64)
        crowd.add(x)
    check_links(spark, crowd | {rnd.getrandbits(64) for _ in range(100)})


def test_grid_loses_no_pair(spark):
    rnd = random.Random(6)
    prints = set()
    for _ in range(60):
        a = rnd.getrandbits(64)
        prints |= {a, a ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64)}
    check_links(spark, prints)


def test_distance_in_sql(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(7)
    pairs = [(signed(rnd.getrandbits(64)), signed(rnd.getrandbits(64))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = df.select("a", "b", S.manhattan(S.popcounts(F.col("a")), S.popcounts(F.col("b"))).alias("d")).collect()
    for r in rows:
        vec = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
        assert r["d"] == sum(abs(p - q) for p, q in zip(vec(r["a"]), vec(r["b"])))
