import random

import fixtures as X
import numpy as np

from corrweave.llm import sharding as S


def places(df):
    return {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in df.collect()}


def check(df, n, shards=8):
    rows = df.collect()
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_law_and_columns(spark):
    docs = X.documents(spark, shard="clash", slot=3, _cw_bucket=1)
    out = S.shuffle_to_shards(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_cw_bucket", "shard", "slot"]
    check(out, len(X.ROWS))
    assert X.same([tuple(r)[:4] for r in out.collect()], X.ROWS)
    assert S.shuffle_to_shards(docs.filter("doc_id < 0")).count() == 0


def test_same_places_however_rows_arrive(spark):
    rows = [(i, f"text {i % 90}", "en", "a") for i in range(500)]
    docs = X.documents(spark, rows)
    whole = places(S.shuffle_to_shards(docs, bucket_bytes=600))
    assert whole == places(S.shuffle_to_shards(docs.repartition(7, "text"), bucket_bytes=600))
    assert whole != places(S.shuffle_to_shards(docs, seed=1, bucket_bytes=600))
    check(S.shuffle_to_shards(docs, n_shards=5, bucket_bytes=600), 500, 5)


def test_order_is_random(spark):
    rows = [(i, "x", "en", "a") for i in range(4000)]
    got = S.shuffle_to_shards(X.documents(spark, rows)).orderBy("shard", "slot").collect()
    ids = np.array([r["doc_id"] for r in got])
    assert abs(np.corrcoef(ids, np.arange(4000))[0, 1]) < 0.08 and abs(np.corrcoef(ids[1:], ids[:-1])[0, 1]) < 0.08


def test_repeated_rows_beyond_a_bucket(spark):
    rows = [(1, "same" * 20, "en", "a")] * 700 + [(i, "other", "en", "a") for i in range(300)]
    check(S.shuffle_to_shards(X.documents(spark, rows), bucket_bytes=4000), 1000)


def test_written_shards_are_in_slot_order(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, "w" * rnd.randint(0, 50), "en", "a") for i in range(300)]
    S.write_shards(S.shuffle_to_shards(X.documents(spark, rows), bucket_bytes=1500), str(tmp_path / "out"))
    import pyarrow.parquet as pq

    for k in range(8):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [s for f in files for s in pq.ParquetFile(f).read().column("slot").to_pylist()]
        assert slots == list(range(len(slots)))


def test_query(spark, tmp_path):
    import zlib

    X.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = S.op4_sharding(spark, str(tmp_path)).collect()
    assert X.same([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in X.ROWS])
