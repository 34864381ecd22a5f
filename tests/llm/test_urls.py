from tidepool.llm import urls as llm_urls
from tidepool.llm.urls import judge_urls

PAGES = "page_id long, url string, html string"


def test_rules_and_hosts(spark):
    urls = [
        "http://a.example.com/en/x", "https://WWW.Example.com/en/", "http://x.net/es/1", "http://net/es/", "http://xnet/es/", "ftp://h.org/p?q=/es/#f", None, "no scheme", "http://", "http://a.com",
        "http://a.com/?x", "http://A.Com:80/x", "x://b.com/en/?u=http://net/es/", "http://b.net/fr/../x",
    ]
    rows = {r.page_id: r for r in judge_urls(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)).collect()}
    got = [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(rows.items())]
    assert got == [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/es/1", "net/es/", "block"), ("net", "/es/", "net/es/", "block"),
        ("xnet", "/es/", None, "allow"), ("h.org", "/p", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"),
        ("a.com", "/", "com/", "allow"), ("a.com:80", "/x", None, "allow"), ("b.com", "/en/", "com/", "allow"), ("b.net", "/fr/../x", "net/fr/", "block"),
    ]


def test_blocks_spread_over_aliases_and_allows_win(spark):
    link = '<link href="{0}" rel="canonical">'.format
    refresh = '<meta http-equiv="refresh" content="0; url={0}">'.format
    pages = [
        (1, "http://a.org/1", link("http://b.org/2#top")),
        (2, "http://b.org/2", refresh("http://spam.net/es/3")),
        (3, "http://spam.net/es/3", ""),
        (4, "http://c.org/x/4", link("/y")),
        (5, "http://c.org/y", refresh("http://ok.com/")),
        (6, "http://c.org/y#part", link("//spam.net/fr/")),
        (7, "http://d.org/7", None),
        (8, "http://b.org/2#again", None),
        (8, "http://b.org/2#again", None),
        (None, None, link("http://b.org/2")),
    ]
    rows = judge_urls(spark.createDataFrame(pages, PAGES)).collect()
    verdicts = [(r.page_id, r.verdict) for r in rows]
    assert sorted(v for v in verdicts if v[0]) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block"), (8, "block")]
    more = spark.createDataFrame([("http://d.org/7", "http://a.org/1"), (None, "x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, PAGES), edges=more).collect()}[7] == "block"
    assert judge_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_planted_aliases_against_brute_force(spark):
    """Chains and stars of links in several spellings; a component's verdict reaches all of its pages."""
    import random

    rng = random.Random(12)
    hosts = ["example.com", "www.example.com", "a.net", "b.org", "c.org", "d.io"]
    plain = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'x'])}/{i}" for i in range(120)]
    links = [(i, rng.randrange(120)) for i in range(120) for _ in range(rng.choice([0, 0, 1, 2]))]

    def spelled(url):
        host = url.split("/")[2]
        return url.replace(host, rng.choice([host, host.upper(), host + ":80"]), 1) + rng.choice(["", "#part"])

    html = {i: "".join(f'<link href="{spelled(plain[b])}" rel=canonical>' if k % 2 else f'<meta http-equiv="refresh" content="0; url={spelled(plain[b])}">' for k, (a, b) in enumerate(links) if a == i) for i in range(120)}
    pages = spark.createDataFrame([(i, u, html[i], 1, "x") for i, u in enumerate(plain)], "page_id long, url string, html string, component int, node string")
    root = list(range(120))
    for _ in range(120):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])

    def rule(url):
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
        fits = [(len(h + p), v) for v, h, p in llm_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    own = [rule(u) for u in plain]
    of = {}
    for i, v in enumerate(own):
        of.setdefault(root[i], set()).add(v)
    expected = {i: v or ("allow" if "allow" in of[root[i]] or "block" not in of[root[i]] else "block") for i, v in enumerate(own)}
    got = {r.page_id: r.verdict for r in judge_urls(pages).collect()}
    assert got == expected and any(own[i] is None and v == "block" for i, v in expected.items())


def test_long_pages_take_linear_time(spark):
    """Unclosed tags, one endless tag, runs of white space where numbers are looked for, and a link after all of them."""
    import time

    link = '<link href="http://x.net/es/" rel="canonical">'
    long = ["<link " * 100_000, "<link " * 100_000 + ">" + link, "<meta http-equiv=refresh content=" * 18_000 + " " * 20_000 + ">" + link, "<meta http-equiv=refresh content='" + " " * 600_000 + "'>" + link, "x" * 600_000 + link + "<link rel=canonical href=http://y.org/"]
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in enumerate(long)], PAGES).repartition(5)
    llm_urls.alias_edges(pages.limit(0)).collect()
    began = time.perf_counter()
    got = {r.page_id: r.verdict for r in judge_urls(pages).collect()}
    assert time.perf_counter() - began < 30
    assert got == {0: "allow", 1: "block", 2: "block", 3: "block", 4: "block"}


def test_planted_links_against_the_sql(spark, tmp_path):
    """Any order of attributes, relative links, spellings; the query's SQL over a table that declares links."""
    import duckdb

    from tidepool.llm import queries

    pages = [
        (1, "http://a.org/x/1", '<link rel="canonical" href="/y/2">'), (2, "http://a.org/y/2", "<LINK HREF='//spam.net/es/3#z' REL=canonical>"), (3, "http://spam.net/es/3", None), (4, "http://A.org:80/y/2", ""),
        (5, "http://c.org/d/e?q", '<meta content="0; url=f" http-equiv=refresh>'), (6, "http://c.org/d/f", '<meta http-equiv="refresh" content="5;url=?k=1&amp;m">'), (7, "http://c.org/d/f?k=1&m", '<link href="http://www.example.com/en/q" rel=canonical>'),
        (8, "https://e.org", '<link href="http://net/fr/" rel="stylesheet"><link rel="canonical" href="https://E.org:443/g">'), (9, "https://e.org/g", "<link rel=canonical href=http://b.net/fr/1"), (10, None, '<link rel="canonical" href="/">'),
        (11, "no scheme", '<link rel="canonical" href="http://spam.net/es/3">'), (11, "no scheme", "x"), (None, "http://a.org/y/2#part", None),
    ]
    spark.createDataFrame(pages, PAGES).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    expected = con.sql(f"select page_id, host, path, rule, verdict from ({queries.URLS})").fetchall()
    got = queries.op3_urls(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    verdicts = {r.page_id: r.verdict for r in got}
    assert [verdicts[i] for i in (1, 2, 3, 4, None, 11)] == ["block"] * 6 and [verdicts[i] for i in (5, 6, 7, 8, 9)] == ["allow"] * 5
