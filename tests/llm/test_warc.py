import base64
import hashlib
import json
import time
import uuid

from corrweave.llm import warc as W

PAGES = [
    (1, "http://a.org/x", "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- <p>no</p> --><p>One&nbsp;two<br>three</p><script>var t='</p>';</script><a href=\"/l?a=1&amp;b\">link</a> <a class=x href='q'>z</a></body></html>"),
    (2, None, None),
    (3, "http://b.org", "plain\r\n\r\ntext &lt;b&gt; é \U0001f600"),
    (3, "http://b.org", "plain\r\n\r\ntext &lt;b&gt; é \U0001f600"),
    (None, "http://c.org", "<p><p></p>"),
]


def records(spark, pages=PAGES):
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, block string, record_id int")
    return W.derive(W.responses(df))


def test_linked_records(spark):
    rows = records(spark).collect()
    assert len(rows) == 2 * len(PAGES) and records(spark, []).count() == 0
    one = {r["warc_type"]: r for r in rows if r["page_id"] == 1}
    assert one["conversion"]["block"] == "A & B\nOne two\nthree\nlink z"
    doc = json.loads(one["metadata"]["block"])["Envelope"]
    assert doc["HTML"] == {"Title": "A & B", "Links": ["/l?a=1&b", "q"]}
    source = doc["WARC-Header"]
    assert source["WARC-Target-URI"] == "http://a.org/x" and doc["HTTP-Response"]["Headers"][0] == ["Content-Type", "text/html; charset=utf-8"]
    for r in rows:
        assert r["block_digest"] == W.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        assert r["record_id"] != r["refers_to"] and r["refers_to"].startswith("<urn:uuid:")
    assert {r["refers_to"] for r in one.values()} == {source["WARC-Record-ID"]} and {r["source_digest"] for r in one.values()} == {source["WARC-Payload-Digest"]}
    empty = [r for r in rows if r["page_id"] == 2 and r["warc_type"] == "conversion"]
    assert empty[0]["block"] == "" and empty[0]["target_uri"] == ""
    assert len({r["record_id"] for r in rows if r["page_id"] == 3}) == 2


def test_round_trip(spark, tmp_path):
    made = records(spark)
    expected = sorted((r["record_id"], r["refers_to"], r["block_digest"], r["block"]) for r in made.collect())
    for kind in ("none", "gzip"):
        path = str(tmp_path / kind)
        W.write_warc(made, path, compression=kind)
        got = W.read_warc(spark, path).collect()
        assert sorted((r["headers"]["WARC-Record-ID"], r["headers"]["WARC-Refers-To"], r["headers"]["WARC-Block-Digest"], r["block"]) for r in got) == expected
        assert all(W.digest(r["block"].encode()) == r["headers"]["WARC-Block-Digest"] for r in got)


HTML = [
    "<p>a<b>b</b> c<div class='x>'>d</div>", "<!-- open <p>x", "<script>a<p>", "<SCRIPT>a</Script >b", "x < y <p>z", "<a href='1'>q</a><A\nHREF=\"2>3\">r</a><a hrefx=4><a href=>", "<title>T &lt; U</title><title>V</title>",
    "<style>s</style><template>t</template>u<noscript>v</noscript>", "", "<>", "a<br/>b<hr>c", "&amp;nbsp;&#65;", "<h1>x</h1><h7>y</h7>",
]
TEXTS = ["ab c\n'>d", "<!-- open\nx", "a", "b", "x < y\nz", 'q3">r', "T < U\nV", "u", "", "<>", "a\nb\nc", "&nbsp;A", "x\ny"]


def test_plain_text_by_hand():
    assert [W.plain_text(h) for h in HTML] == TEXTS
    assert W.links_of(HTML[5]) == ["1", "2>3"] and W.title_of(HTML[6]) == "T < U" and W.title_of("<title>x") == W.title_of("<title") == ""


def test_hostile_pages_take_linear_time():
    for unit in ("<script>", "<!--", "<title>", "<title ", "<a ", "<a href=\"", "<p ", "<", "</script ", "<a href='x", "<a>", "&", "<style", " ", "href = ", "<a " + "href " * 9):
        for tail in ("", ">", "-->"):
            began = time.perf_counter()
            W.describe({"http_head": "", "record_id": "", "target_uri": "", "warc_date": "", "payload": unit * (5_000_000 // len(unit)) + tail})
            assert time.perf_counter() - began < 15, unit


def test_ids_tell_different_pages_apart(spark):
    pages = [(1, "u", "<p>a"), (1, "u", "<p>b"), (None, None, "<p>a"), (None, None, "<p>b"), (None, "u", "<p>a"), (1, None, "<p>a")]
    rows = records(spark, pages).collect()
    assert len({r["record_id"] for r in rows}) == 12 and len({r["refers_to"] for r in rows}) == 6


def test_against_brute_force(spark):
    """Every record of the query stated plainly, page by page."""
    pages = [(i, f"http://h{i % 5}.org/{i}", h) for i, h in enumerate(HTML)]
    got = {(r["page_id"], r["warc_type"]): r for r in records(spark, pages).collect()}
    for (i, url, h), text in zip(pages, TEXTS, strict=True):
        source = "sha1:" + base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        response = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response|{i}|{url}|{source}')}>"
        for kind in ("metadata", "conversion"):
            r = got[i, kind]
            assert (r["refers_to"], r["target_uri"], r["source_digest"]) == (response, url, source)
            assert r["record_id"] == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{response}')}>"
        assert got[i, "conversion"]["block"] == text
        doc = json.loads(got[i, "metadata"]["block"])["Envelope"]
        assert doc["WARC-Header"] == {"WARC-Type": "response", "WARC-Record-ID": response, "WARC-Target-URI": url, "WARC-Date": W.CAPTURE_DATE, "WARC-Payload-Digest": source}
        assert doc["HTTP-Response"] == {"Status": "HTTP/1.1 200 OK", "Headers": [["Content-Type", "text/html; charset=utf-8"], ["Content-Length", str(len(h))]], "Entity-Length": len(h)}


def test_query_and_repeated_headers(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert W.op7_warc_derivatives(spark, str(tmp_path)).count() == 2 * len(PAGES)
    head = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nEmpty:\r\nSet-Cookie: a=1"
    found = spark.createDataFrame([(1, "<urn:uuid:1>", "u", "d", head, "<p>x")], W.RESPONSE_SCHEMA)
    W.write_warc(W.derive(found), str(tmp_path / "out"))
    blocks = [r["block"] for r in W.read_warc(spark, str(tmp_path / "out")).collect() if r["headers"]["WARC-Type"] == "metadata"]
    assert json.loads(blocks[0])["Envelope"]["HTTP-Response"]["Headers"] == [["Set-Cookie", "a=1"], ["set-cookie", "b=2"], ["Empty", ""], ["Set-Cookie", "a=1"]]


def record(fields, block, version="WARC/1.0", eol="\r\n", length=None):
    lines = [version, *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block) if length is None else length}", ""]
    return eol.join([*lines, ""]).encode() + block + (eol * 2).encode()


SEPARATED = b"<p>a page\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.1\r\nmore of it"
FILES = [
    record([("WARC-Type", "warcinfo")], b"about"),
    record([("WARC-Type", "response"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>"), ("warc-concurrent-to", "<c>"), ("Folded", "one\r\n two")], SEPARATED, "WARC/1.1"),
    record([("WARC-Type", "resource")], b""),
    record([("WARC-Type", "resource")], bytes(range(256)) * 20, "WARC/1.1"),
    record([("WARC-Type", "metadata")], b"plain line ends", eol="\n"),
    record([("WARC-Type", "resource")], b"WARC/1.0\r\n" * 50),
]


def expected(parts=FILES):
    blocks = [b"about", SEPARATED, b"", bytes(range(256)) * 20, b"plain line ends", b"WARC/1.0\r\n" * 50]
    return blocks[: len(parts)]


def test_reader_obeys_lengths_wherever_files_are_split(spark, tmp_path):
    import gzip

    (tmp_path / "a.warc").write_bytes(b"".join(FILES))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, FILES)))
    (tmp_path / "empty.warc").write_bytes(b"")
    for size in ("64", "333", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = W.read_warc(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for name in ("a.warc", "members.warc.gz"):
            got = sorted((r for r in rows if r["file"].endswith(name)), key=lambda r: r["record"])
            assert [bytes(r["content"]) for r in got] == expected() and [r["version"] for r in got] == ["WARC/1.0", "WARC/1.1", "WARC/1.0", "WARC/1.1", "WARC/1.0", "WARC/1.0"]
            assert [tuple(f) for f in got[1]["fields"]][:5] == [("WARC-Type", "response"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>"), ("warc-concurrent-to", "<c>"), ("Folded", "one two")]
            assert got[1]["headers"]["WARC-Concurrent-To"] == "<a>" and not any(r["truncated"] for r in got)
        assert len(rows) == 12


def test_reader_goes_on_after_damage(spark, tmp_path):
    bad = [record([("WARC-Type", "resource")], b"wrong length", length=5000), record([("WARC-Type", "resource")], b"no length").replace(b"Content-Length: 9\r\n", b""), FILES[0], record([("WARC-Type", "resource")], b"short", length=99)]
    (tmp_path / "b.warc").write_bytes(b"rubbish before\r\n\r\n" + b"".join(bad[1:]))
    got = sorted(W.read_warc(spark, str(tmp_path / "b.warc")).collect(), key=lambda r: r["record"])
    assert [r["block"] for r in got][:2] == ["no length", "about"] and [r["truncated"] for r in got] == [False, False, True] and got[2]["block"].startswith("short")
    (tmp_path / "c.warc").write_bytes(b"".join(bad[:1]) + b"x" * 4984 + b"\r\n\r\n" + FILES[0])
    assert [r["truncated"] for r in W.read_warc(spark, str(tmp_path / "c.warc")).collect()] == [False, False]


def test_read_responses_are_derived(spark, tmp_path):
    head = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Twice: 1\r\nX-Twice: 2"
    page = "<title>Gone\r\n\r\n</title><a href='http://else.where/'>it's gone, süß</a>".encode()
    own = [("WARC-Type", "response"), ("warc-record-id", "<urn:uuid:r>"), ("WARC-Target-URI", "http://x.org/"), ("WARC-Date", "2020-02-02T00:00:00Z")]
    (tmp_path / "r.warc").write_bytes(FILES[0] + record(own, head + b"\r\n\r\n" + page, "WARC/1.1") + record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:s>")], b"HTTP/1.1 204 No Content"))
    got = {(r["refers_to"], r["warc_type"]): r for r in W.derive(W.responses_of(W.read_warc(spark, str(tmp_path / "r.warc")))).collect()}
    assert len(got) == 4
    meta = json.loads(got["<urn:uuid:r>", "metadata"]["block"])["Envelope"]
    assert meta["HTTP-Response"]["Status"] == "HTTP/1.1 404 Not Found" and ["X-Twice", "2"] in meta["HTTP-Response"]["Headers"] and meta["WARC-Header"]["WARC-Date"] == "2020-02-02T00:00:00Z"
    assert "süß" in got["<urn:uuid:r>", "conversion"]["block"] and got["<urn:uuid:s>", "conversion"]["block"] == ""
