import fixtures as X

from corrweave.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = X.words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {j for i, g in enumerate(windows) if windows.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if X.words(x)]
    chars = sum(map(len, w))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(repeated), sum("A" <= c <= "Z" for c in text), len(lines)


ROWS = [*X.ROWS, *((20 + i, t, "en", "a") for i, t in enumerate([
    "x y z " * 40, "a b a b a", "a a a a", "### *** $$$ | <b>&amp;</b>", "Same line\nSame line\nSame line ", ("one two three four %d " * 30) % tuple(range(30)),
]))]


def test_measurements_and_policies(spark):
    led = Q.ledger(X.documents(spark, ROWS, n_words="clash", kept=1))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_word_lines"]
    got = [(r["doc_id"], *(r[n] for n in names)) for r in led.collect()]
    assert X.same(got, [(r[0], *brute(r[1])) for r in ROWS])
    for r in Q.apply_policy(led, "base").collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["kept"] != failed
    assert all(r["kept"] == (r["fail_bits"] == 0) for r in Q.apply_policy(led).collect())


def test_ablation_equals_recount(spark):
    led = Q.ledger(X.documents(spark, ROWS))
    bits = [r["fail_bits"] for r in led.collect()]
    for policy, rules in Q.POLICIES.items():
        got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in Q.ablation(led, policy).collect()}
        m = Q.mask(policy)
        assert got == {r: (sum(b & Q.BIT[r] != 0 for b in bits), sum(b & m == Q.BIT[r] for b in bits)) for r in rules}


def test_no_python_and_empty(spark, tmp_path):
    docs = X.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = Q.op3_quality_rules(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert Q.ledger(docs.filter("doc_id < 0")).count() == 0


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op3_quality_rules(spark, sf).filter("NOT base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["kept"] for r in good) / len(good) > 0.97
