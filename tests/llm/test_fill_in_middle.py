import hashlib
import random
import re

import duckdb
import fixtures as X
import pytest

from corrweave.llm import fill_in_middle as M

SF = "/root/testdata/sf0.01"
MORE = [
    (20, "\n", "en", "a"),
    (21, "\n\n\n", "en", "a"),
    (22, "no end\nof line", "en", "a"),
    (23, "ended\nby a line\n", "en", "a"),
    (24, "a mark <S> inside", "en", "a"),
    (25, "a mark <P\n> that isn't one", "en", "a"),
    (26, "ü\n" * 400 + "é" * 900, "en", "a"),
    (27, "\r\n \x85\x0b\n", "en", "a"),
]


def brute(doc_id, text, seed=7, fim_rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, sha = len(units), lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_rate:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < spm_rate
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("frame_bytes", [1, 2, 3, 7, 64, 1 << 16])
def test_frames(frame_bytes):
    rnd = random.Random(frame_bytes)
    for _ in range(60):
        text = "".join(rnd.choice("ab\n\nüñ\U0001f600<P>SM") for _ in range(rnd.randint(0, 120)))
        data, units = text.encode(), re.findall(r"[^\n]*\n|[^\n]+", text)
        x = M.stored(iter([data]), frame_bytes)
        assert x.n_units == len(units) and x.chars[-1] == len(text) and x.sizes[-1] == len(data)
        assert all(len(M._unpack(f)) <= frame_bytes for f in x.data)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert x.place(k) == (len(head.encode()), len(head))
        i, j = sorted(rnd.randint(0, len(data)) for _ in "ab")
        assert b"".join(x.stream(i, j)) == data[i:j]
        assert x.find(b"<P>", i) == data.find(b"<P>", i)
        assert M.from_row(M.to_row(x)) == x


def test_only_the_frames_of_the_cuts_are_opened(monkeypatch):
    text = "".join(f"line {i} of a long text\n" for i in range(20_000))
    x = M.stored(iter([text.encode()]), 4096)
    opened, unpack = [], M._unpack
    monkeypatch.setattr(M, "_unpack", lambda f: opened.append(f) or unpack(f))
    x.place(5_000)
    x.place(15_000)
    assert len(opened) == 2 and len(x.data) > 100


def test_against_brute_force(spark):
    rows = [*X.ROWS, *MORE, (30, None, None, None), (31, ("many words on a line " * 9 + "\n") * 8_000, "en", "a"), (32, "w" * 1_500_000, "en", "a")]
    docs = X.documents(spark, rows, n="clash", FORM=1, stored=2)
    for frame_bytes, fim, spm in ((M.FRAME_BYTES, 100, 50), (50, 60, 20)):
        out = M.restore(M.fill_in_middle(M.store_frames(docs.filter("text IS NULL OR length(text) < 1000 OR " + str(frame_bytes > 99)), frame_bytes), fim_rate=fim, spm_rate=spm))
        got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()]
        kept = [r for r in rows if frame_bytes > 99 or len(r[1] or "") < 1000]
        assert X.same(got, [(r[0], *brute(r[0], r[1], 7, fim, spm)) for r in kept])


def test_texts_come_back(spark):
    docs = X.documents(spark)
    out = M.fill_in_middle(M.store_frames(docs))
    texts = lambda df: [tuple(r) for r in M.load_texts(df).select("doc_id", "text", "lang", "n_chars").collect()]
    assert X.same(texts(M.restore(out)), [(r[0], r[1] or "", r[2], None if r[1] is None else len(r[1])) for r in X.ROWS])
    marked = [t for _, t, *_ in texts(out) if t]
    assert sum("<P>" in t and "<S>" in t and "<M>" in t for t in marked) == len([r for r in X.ROWS if r[1]])
    assert M.restore(M.fill_in_middle(M.store_frames(docs.filter("doc_id < 0")))).count() == 0


def test_query(spark):
    got = [tuple(r) for r in M.op13_fill_in_middle(spark, SF).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert X.same(got, con.sql(M.ORACLE_SQL).fetchall())
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert X.same(got, [(d, *brute(d, t)) for d, t in rows]) and {r[2] for r in got} >= {"psm", "spm"}
