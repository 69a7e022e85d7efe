import time

import pytest

from corrweave.llm import url_filter as U

URLS = [
    "http://Example.ORG/es/1", "https://a.example.org/en/12?x", "https://a.example.org/en/2#f", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/en/", None, "", "no scheme/org/",
    "http://org/", "http://notorg.net/", "http://farm.example.net", "http://m.farm.example.net/a", "http://nofarm.example.net/a", "http://example.org", "http://example.org?/es/",
    "http://m.casino-win.example.com/x", "http://casinowin.com", "http://poker", "http://a.-.b/", "http://.", "http://POKER.casino-x.org/fr/",
    "ftp://ÉX.com/fr/é", "http://a://b.org/x", "http://farm.example.org/fr/",
]


HOSTS = [f"farm.example.{top}" for top in ("com", "net", "org")]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(h + p, a) for h, p, a in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, action = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, "allow" if action == U.ALLOW else "block"
    listed = any(host == h or host.endswith("." + h) for h in HOSTS) or bool(set(host.replace("-", ".").split(".")) & set(U.BLOCKED_WORDS))
    return host, path, None, "block" if listed else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")


def test_verdicts(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in U.filter_urls(pages(spark, URLS), blocked_hosts=HOSTS).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert U.filter_urls(pages(spark, [])).count() == 0
    assert {r["verdict"] for r in U.filter_urls(pages(spark, URLS), rules=(), blocked_words=()).collect()} == {"allow"}


def test_query_and_lists_from_tables(spark, tmp_path):
    pages(spark, URLS).drop("host", "verdict").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in U.op8_url_filter(spark, str(tmp_path)).collect()}
    plain = {i: brute(u) for i, u in enumerate(URLS)}
    assert {i: g for i, g in got.items() if "farm" not in g[0]} == {i: (p[0], p[3]) for i, p in plain.items() if "farm" not in p[0]}
    listed = spark.createDataFrame([(f"host{i}.com",) for i in range(20_000)] + [(None,), ("FARM.example.com",)], "host string")
    rows = U.filter_urls(pages(spark, ["http://a.host19999.com/x", "http://host20000.com/x", "http://farm.example.com"]), blocked_hosts=listed).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block", "allow", "block"]


def test_very_long_urls(tmp_path):
    path = tmp_path / "index.bin"
    path.write_bytes(U.build([("example.org/es/", U.BLOCK), ("~poker", U.LISTED)]))
    index = U.DigestArray(str(path))
    urls = ["http://" + "a." * 500_000 + "example.org/es/" + "x" * 1_000_000, "http://" + "b-" * 500_000 + "poker", "http://" + "." * 1_000_000, "x" * 1_000_000]
    began = time.perf_counter()
    assert [v for *_, v in U.judge(index, urls)] == ["block", "block", "allow", "allow"]
    assert time.perf_counter() - began < 4


@pytest.fixture
def all_alike(monkeypatch):
    class Same:
        xxh64_intdigest = staticmethod(lambda s: 7)

    monkeypatch.setattr(U, "xxhash", Same)


def find(tmp_path, entries, probes):
    path = tmp_path / "index.bin"
    path.write_bytes(U.build(entries))
    index = U.DigestArray(str(path))
    return [None if i < 0 else int(index.actions[i]) for i in index.find(probes)]


def test_collisions_change_nothing(tmp_path, all_alike):
    entries = [(f"host{i}.com", i % 3) for i in range(50)]
    assert find(tmp_path, entries, [b"host7.com", b"host49.com", b"host50.com", b""]) == [1, 1, None, None]


def test_large_array(tmp_path):
    entries = [(f"host{i}.com", i % 3) for i in range(20_000)]
    probes = [f"host{i}.com".encode() for i in range(0, 40_000, 7)]
    assert find(tmp_path, entries, probes) == [i % 3 if i < 20_000 else None for i in range(0, 40_000, 7)]
    assert find(tmp_path, [], [b"x"]) == [None]
    with pytest.raises(ValueError):
        (tmp_path / "other.bin").write_bytes(b"x" * 100)
        U.DigestArray(str(tmp_path / "other.bin"))
