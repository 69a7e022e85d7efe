import fixtures as X
import numpy as np

from corrweave.llm import quality_classifier as Q

SF = "/root/testdata/sf0.1"
GOOD = [(100 + i, f"A calm and ordinary sentence about topic {i} that people might read with some interest, and another one.", "en", "a") for i in range(60)]
BAD = [(300 + i, f"BUY!! NOW!! CHEAP!! DEAL {i}!! ### $$$ BUY!! NOW!! " * 3, "en", "a") for i in range(60)]


def labelled(spark, rows=GOOD + BAD):
    return spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows] + [(None, 1, 0), (999, None, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")


def test_scores_and_stage(spark):
    rows = [*X.ROWS, *GOOD, *BAD]
    docs = X.documents(spark, rows, quality=1, quality_score="clash", raw=2)
    labels = labelled(spark)
    got = Q.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got)
    score = {r["doc_id"]: r["quality_score"] for r in got}
    assert min(score[r[0]] for r in GOOD) > 0.9 and max(score[r[0]] for r in BAD) < 0.1
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {"clash"} == {r["quality_score"] for r in kept.collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {d for d, s in score.items() if s >= Q.CUT}
    # Held-out labels aren't learnt from, and neither source nor id matters.
    flipped = labels.selectExpr("doc_id", f"CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["quality_score"] for r in Q.score_quality(docs.withColumnRenamed("source", "s").drop("lang"), flipped).collect()}
    assert all(np.isclose(again[d], s) for d, s in score.items())


def test_without_labels_or_rows(spark):
    docs = X.documents(spark)
    none = labelled(spark, []).filter("doc_id < 0")
    assert {r["quality_score"] for r in Q.score_quality(docs, none).collect()} == {1.0}
    assert Q.score_quality(docs.filter("doc_id < 0"), labelled(spark)).count() == 0


def test_scores_are_cosine_votes():
    rng = np.random.default_rng(1)
    raw = rng.random((40, Q.WIDTH)).astype(np.float32) * (rng.random((40, Q.WIDTH)) < 0.05)
    labels = rng.integers(0, 2, 40)
    voter = Q.Voter(raw, labels, rank=8)
    for x in raw[:5]:
        v = x * voter.idf
        v = (v / np.linalg.norm(v)) @ voter.basis
        cos = voter.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cos)[: Q.NEIGHBOURS]
        w = np.maximum(cos[near], 1e-6) ** Q.POWER
        assert np.isclose(voter.scores(x[None])[0], (w * labels[near]).sum() / w.sum(), atol=1e-4)


def test_held_out_accuracy(spark):
    found = Q.op10_quality_classifier(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r for r in found if r["quality"] == 1]
    bad = [r for r in found if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) > 0.98
    assert sum(r["predicted"] for r in bad) / len(bad) < 0.1
