import math
import random

import fixtures as X
import numpy as np
from pyspark.sql import functions as F

from corrweave.llm import language_id as L

SF = "/root/testdata/sf0.1"
TEXTS = {
    "aa": ["banana bandana band and an and banal", "a nab and a ban"],
    "bb": ["mississippi miss sips spiss", "imps sip sims"],
    "cc": ["über die brücke für müde füße", "öde äste"],
}


def learnt_text(texts, most=L.SAMPLE_BYTES):
    return b"\0".join(L.normal(t) for t in texts)[:most]


def parse(data, train, window):
    """Phrases of a greedy parse by searching the learnt text."""
    count = 0
    for w in range(0, len(data), window):
        piece, i = data[w : w + window], 0
        while i < len(piece):
            n = 1
            while i + n < len(piece) and piece[i : i + n + 1] in train:
                n += 1
            i += n
            count += 1
    return count


def model(texts=TEXTS):
    return L.Model([L.learn(lang, t) for lang, t in texts.items()])


def test_automaton_takes_the_substrings():
    rnd = random.Random(1)
    for _ in range(40):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 25)))
        moves = L.suffix_automaton(data)
        assert len(moves) <= max(1, 2 * len(data))

        def takes(word, moves=moves):
            state = 0
            for c in word:
                if c not in moves[state]:
                    return False
                state = moves[state][c]
            return True

        for _ in range(60):
            word = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 6)))
            assert takes(word) == (word in data)


def test_phrases_against_search():
    rnd = random.Random(2)
    m = model()
    texts = [L.normal("".join(rnd.choice("abndmisp füe\U0001f600z") for _ in range(rnd.randint(1, 90)))) for _ in range(60)]
    texts += [L.normal("banana"), b"", L.normal("x")]
    for window in (1, 5, 16, 2048):
        got = m.phrases(texts, window)
        for k, lang in enumerate(m.langs):
            assert got[k].tolist() == [parse(t, learnt_text(TEXTS[lang]), window) for t in texts]


def test_predictions_are_the_least_entropy():
    m = model()
    texts = ["banal bananas", "miss sips", "die füße", "", None, " \n1234 !?", "ß", "Ж", "and miss über"]
    langs, scores = m.predict(texts)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        if not t or not L.has_letter(t):
            assert (lang, score) == ("und", 0)
            continue
        bits = {k: parse(L.normal(t), learnt_text(v), L.WINDOW) * math.log2(sum(len(L.normal(x)) for x in v)) for k, v in TEXTS.items()}
        assert lang == min(bits, key=lambda k: (bits[k], k))
        assert math.isclose(score, 1 / sum((min(bits.values()) / b) ** L.POWER for b in bits.values())) and 0 < score <= 1
    assert langs[:3] == ["aa", "bb", "cc"]
    alike = L.Model([L.learn("y", ["same text"]), L.learn("x", ["same text"])])
    assert alike.predict(["same"])[0] == ["x"]  # a tie goes to the least name
    assert L.Model([]).predict(["same"])[0] == ["und"] and L.Model([L.learn("x", ["abc"])]).predict(["zzz"])[1].tolist() == [1.0]
    assert L.learn("x", ["123", ""]) is None


def test_long_texts_are_parsed_whole():
    m = model()
    long = "banana bandana and " * 3_000 + "mississippi sips miss imps " * 9_000
    assert m.predict([long])[0] == ["bb"] and m.predict(["banana bandana and " * 9_000 + "miss sip " * 500])[0] == ["aa"]


def labelled():
    rnd = random.Random(3)
    words = {k: " ".join(v).split() for k, v in TEXTS.items()}
    return [(1000 + i, " ".join(rnd.choices(words[k], k=12)), k, "s") for i in range(160) for k in [rnd.choice(sorted(words))]]


def test_rows_and_columns(spark):
    rows = labelled() + [(None, "banana and band", "aa", "s"), (1, None, "aa", "s"), (2, "", "bb", None), (3, "99", None, "s"), (4, "sips miss", None, "s"), (5, "und Ж", "", "s")]
    docs = X.documents(spark, rows, LANG_PRED="clash", score=3, extra=1)
    m = L.fit(docs)
    assert m.langs == ["", "aa", "bb", "cc"] or m.langs == ["aa", "bb", "cc"]  # the empty name's one row may be held out
    out = L.identify(docs, m)
    assert out.columns == [*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")], "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert (found[1], found[2], found[3], found[4], found[None]) == ("und", "und", "und", "bb", "aa")
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["doc_id"] and r["doc_id"] >= 1000]) > 0.95
    # Held-out rows teach nothing, and lang, source and doc_id decide nothing.
    wrong = docs.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert L.fit(wrong).langs == m.langs
    again = {r["text"]: (r["lang_pred"], r["score"]) for r in L.identify(docs.select("text"), m).collect()}
    assert all(again[r["text"]] == (r["lang_pred"], r["score"]) for r in got)
    assert L.fit(docs.filter("lang IS NULL")).langs == [] and L.identify(docs.filter("doc_id < 0"), m).count() == 0


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def test_the_sample_is_bounded(spark):
    long = [(i, "banana bandana " * 5_000, "aa", "s") for i in range(9)] + [(100 + i, f"miss sips number{i} " * 20, "bb", "s") for i in range(300)]
    m = L.fit(X.documents(spark, long), sample_rows=8, sample_bytes=3_000, all_bytes=4_000)
    assert m.langs == ["aa", "bb"] and all(x.size <= 2_000 for x in m.learnt)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.op12_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.995
