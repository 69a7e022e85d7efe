import fixtures as X

from corrweave.llm import decontamination as D

ITEMS = [
    (1, "quick brown fox jumps over the lazy dog while"),
    (2, "Seven wise OWLS"),
    (3, "seven wise owls watch from a new oak tree"),
    (4, None),
    (5, "  "),
    (6, "one"),
    (7, "word3 word4 word5 word6 word7 word8 word9 word10 word11 wordX"),
    (7, "word3 word4 word5 word6 word7 word8 word9 word10 word11 wordX"),
    (8, " ".join(f"word{i}" for i in range(100, 160)) + " and an end of another kind that goes on"),
    (9, " ".join(f"word{i}" for i in range(200, 260)) + " end of another kind"),
]


def brute(rows, items):
    out = set()
    for item_id, item in items:
        w = X.words(X.lower(item))
        s = min(5, len(w))
        grams = {tuple(w[i : i + s]) for i in range(len(w) - s + 1)} if s else set()
        for doc_id, text, *_ in rows:
            v = X.words(X.lower(text))
            found = len(grams & {tuple(v[i : i + s]) for i in range(len(v) - s + 1)}) if s else 0
            if grams and found * 5 >= len(grams) * 4:
                out.add((doc_id, item_id, len(grams), found))
    return out


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_pairs_and_stage(spark):
    docs = X.documents(spark, d1="clash", item_id=3, text_hash=1, w=2)
    expected = brute(X.ROWS, ITEMS)
    assert {8, 9, 7} & {i for _, i, *_ in expected} and len(expected) > 6
    got = [tuple(r)[:4] for r in D.contaminated_pairs(docs, bench(spark)).collect()]
    assert X.same(got, expected)
    kept = D.drop_contaminated(docs, bench(spark))
    assert kept.columns == docs.columns
    bad = {d for d, *_ in expected}
    assert X.same([r["doc_id"] for r in kept.select("doc_id").collect()] and [(r["doc_id"],) for r in kept.collect()], [(r[0],) for r in X.ROWS if r[0] not in bad])


def test_empty_sides_and_native_plan(spark):
    docs = X.documents(spark)
    assert D.contaminated_pairs(docs, bench(spark, [])).count() == 0
    assert D.contaminated_pairs(docs.filter("doc_id < 0"), bench(spark)).count() == 0
    assert D.drop_contaminated(docs, bench(spark, [])).count() == len(X.ROWS)
    plan = D.contaminated_pairs(docs, bench(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_signatures_miss_nothing(spark):
    for r in D.items_of(bench(spark)).collect():
        n = r["n"]
        assert len(r["signature"]) >= min(n, n - -(-n * 4 // 5) + 1)
