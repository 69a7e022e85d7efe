import corpus_pipeline
import fixtures as X
import numpy as np
import test_decontamination as TD
import test_line_dedup as TL
import test_near_copies as TN
import test_packing as TP
import test_quality_classifier as TQ
import test_simhash as TS

from corrweave.llm import quality_classifier as Q

BENCH = [(1, "the river bank holds seven wise owls and one quick brown fox at noon")]
ROWS = [
    *TQ.GOOD,
    *TQ.BAD,
    *TS.near_copies(12),
    *((500 + i, "Shared banner line of this site\nAn ordinary sentence about subject number %d which some people might like to read.\nshared BANNER line of this site " % i, "en", "a") for i in range(14)),
    *((600 + i, "Copied text of a calm and ordinary sentence that people might read with some interest.", "en", "hot") for i in range(30)),
    (700, "Some ordinary words come first, then " + BENCH[0][1] + ", and more ordinary words come last.", "en", "a"),
    (701, None, None, None),
]


def stages(rows, labels):
    """The pipeline stated plainly; yields the rows after each stage but the last."""
    known = sorted((d, t) for d, t, *_ in rows if d in labels and X.remainder(d, 4) != 2)
    voter = Q.Voter(np.stack([Q.raw_features(t) for _, t in known]), np.array([labels[d] for d, _ in known]))
    rows = [r for r in rows if voter.scores(Q.raw_features(r[1])[None])[0] >= Q.CUT]
    yield rows
    often, lines = TL.brute(rows, 1, 10, "first")
    seen, out = set(), {}
    for r in sorted(rows):
        kept = []
        for x, gone in lines[r[0], r[1] or ""]:
            k = X.lower(x.strip(X.WHITE))
            if not gone or k not in seen:
                kept.append(x)
            seen.add(k)
        out[r[0]] = "\n".join(kept)
    rows = [(r[0], out[r[0]], *r[2:]) for r in rows]
    yield rows
    kept = set(TN.survivors(rows))
    rows = [r for r in rows if (r[0], r[1] or "") in kept]
    yield rows
    bad = {d for d, *_ in TD.brute(rows, BENCH)}
    yield [r for r in rows if r[0] not in bad]


def test_stages_and_run(spark, tmp_path):
    docs = X.documents(spark, ROWS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = TQ.labelled(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    TD.bench(spark, BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    got = docs
    *most, last = corpus_pipeline.STAGES
    for (name, stage), expected in zip(most, stages(ROWS, known), strict=True):
        got = stage(spark, got, str(tmp_path))
        assert got.columns == docs.columns, name
        assert X.same([tuple(r)[:2] for r in got.collect()], [(r[0], r[1]) for r in expected]), name
        final = expected
    ids = {r[0] for r in final}
    assert 700 not in ids and 600 in ids and not ids & {r[0] for r in TQ.BAD}
    assert {r[1] for r in final if 600 < r[0] < 700} == {""}  # the other copies lost their lines; of empty texts one stays
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert X.same([tuple(r)[:5] for r in rows], TP.expected_pieces(final, 4096))
    TP.check_places(rows, 4096)


def test_empty_corpus(spark, tmp_path):
    X.documents(spark, ROWS[:3]).filter("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    TQ.labelled(spark).write.parquet(str(tmp_path / "labels.parquet"))
    TD.bench(spark, BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
