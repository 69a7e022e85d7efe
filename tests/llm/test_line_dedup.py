import hashlib
import random

import fixtures as X
import numpy as np
import pytest

from corrweave.llm import line_dedup as D


def brute(rows, min_chars, min_docs, keep):
    docs = {(r[0], r[1] or "") for r in rows}
    key = lambda line: X.lower(line.strip(X.WHITE))
    seen = {}
    for doc in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for line in doc[1].split("\n"):
            if len(key(line)) >= min_chars:
                seen.setdefault(key(line), set()).add(doc)
    often = {k for k, v in seen.items() if len(v) >= min_docs}
    return often, {d: [(x, key(x) in often) for x in d[1].split("\n")] for d in docs}


def check(spark, rows, min_chars, min_docs):
    docs = X.documents(spark, rows, n_dropped="clash", keep_bitmap=1)
    often, lines = brute(rows, min_chars, min_docs, "none")
    got = D.drop_duplicate_lines(docs, min_chars, min_docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_bitmap", "n_lines", "n_dropped"]
    expected = []
    for r in rows:
        own = lines[r[0], r[1] or ""]
        expected.append((r[0], "\n".join(x for x, gone in own if not gone), len(own), sum(g for _, g in own)))
    assert X.same([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()], expected)

    got = D.drop_duplicate_lines(docs, min_chars, min_docs, keep="first").collect()
    left = {}
    for r in {(r["doc_id"], r["text"], r["n_dropped"], r["n_lines"]) for r in got}:
        for x in (r[1] or "").split("\n") if r[2] < r[3] else []:
            k = X.lower(x.strip(X.WHITE))
            left[k] = left.get(k, 0) + 1
    assert all(left.get(k) == 1 for k in often)
    for doc, own in lines.items():
        for x, gone in own:
            assert gone or X.lower(x.strip(X.WHITE)) in left


def test_against_brute_force(spark):
    check(spark, X.ROWS, 1, 2)
    rnd = random.Random(1)
    pool = ["Alpha", " alpha\t", "beta", "", "gamma one", "Gamma One ", "rare %d"]
    rows = [(i, "\n".join(rnd.choice(pool).replace("%d", str(rnd.random())) for _ in range(rnd.randint(1, 6))), "en", "hot") for i in range(150)]
    check(spark, rows, 4, 10)
    check(spark, [(i, "all the same\nline", "en", "hot") for i in range(60)], 1, 10)


def test_first_document_is_a_repeated_row(spark):
    first = (1, "own words of one\nshared line\nSHARED line", "en", "hot")
    rows = [first, first, first, *((2 + i, f"own words of {2 + i}\nshared line", "en", "hot") for i in range(40))]
    for size in (1 << 20, 40):  # one partition for most of the lines, and many
        got = D.drop_duplicate_lines(X.documents(spark, rows), 1, 10, keep="first", partition_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            left = ["own words of one", "shared line"] if r["doc_id"] == 1 else [f"own words of {r['doc_id']}"]
            assert r["text"].split("\n") == left


def test_empty_and_bad_mode(spark):
    assert D.drop_duplicate_lines(X.documents(spark).filter("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        D.drop_duplicate_lines(X.documents(spark), keep="last")


def test_runs_over_partition_seams():
    # (hash, document) in order, cut anywhere: totals don't depend on the cuts.
    rnd = random.Random(2)
    for _ in range(200):
        rows = sorted((rnd.randint(0, 4), rnd.randint(0, 5), i) for i in range(rnd.randint(1, 30)))
        cuts = sorted({0, len(rows), *(rnd.randint(0, len(rows)) for _ in range(4))})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        summaries = []
        for pid, part in enumerate(parts):
            cols = [np.array(x, dtype=np.int64) for x in ([r[0] for r in part], [0] * len(part), [r[1] for r in part], [0] * len(part), [r[2] for r in part])]
            starts, n_docs = D._runs(cols)
            ends = [0, (starts[1] if len(starts) > 1 else len(part)) - 1, starts[-1], len(part) - 1]
            first, last = part[0][0], part[-1][0]
            summaries.append((pid, len(starts), first, 0, last, 0, int(n_docs[0]), int(n_docs[-1]), *(x for i in ends for x in (part[i][1], 0))))
        total = {h: len({r[1] for r in rows if r[0] == h}) for h in range(5)}
        for pid, (first_total, before, last_total) in D.join_runs(summaries).items():
            assert first_total == total[parts[pid][0][0]] and last_total == total[parts[pid][-1][0]]
            assert before == (pid > 0 and parts[pid - 1][-1][0] == parts[pid][0][0])


def test_bitmaps():
    for n in (1, 7, 8, 9, 40):
        text = "\n".join(map(str, range(n)))
        for gone in ({0}, {n - 1}, set(range(0, n, 3))):
            kept, lines, dropped = D.apply_bitmap(text, D.pack_bitmap(np.array(sorted(gone))))
            assert (lines, dropped) == (n, len(gone)) and kept == "\n".join(str(i) for i in range(n) if i not in gone)


def test_query_digest(spark, tmp_path):
    X.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = D.op2_line_dedup(spark, str(tmp_path)).collect()
    assert len(rows) == len(X.ROWS)
    digests = {r["doc_id"]: r["kept_sha256"] for r in rows}
    assert digests[4] == digests[5] == hashlib.sha256(b"").hexdigest()


def test_a_million_lines_take_seconds(spark):
    import time

    text = "\n".join(f"line {i % 600_000}" for i in range(1_000_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = D.drop_duplicate_lines(docs, min_docs=2).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in got] == [(1_000_000, 1_000_000, "")] * 2
    assert time.perf_counter() - began < 60


def test_equal_rows_are_combined_before_they_are_dealt(spark):
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one\ntwo\nthree").alias("text"))
    assert D.line_hashes(docs).distinct().count() == 3
    got = D.drop_duplicate_lines(docs, min_docs=2)
    assert got.count() == 100_000 and got.filter("n_dropped > 0").count() == 0
