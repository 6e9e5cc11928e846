from fieldledger.llm.components import components
from fieldledger.llm.url_filter import alias_key, judge_pages

SCHEMA = "page_id long, url string, html string, host string, verdict string"
CANONICAL = '<link rel="canonical" href="{}">'
ROWS = [
    (1, "http://Sub.Example.ORG/es/1?x", None, "block", "example.org/es/"),
    (2, "https://a.org/x", "", "allow", "org/"),
    (3, "http://example.org", "", "allow", None),
    (4, "http://example.org/en/12", "", "block", "example.org/en/1"),
    (5, None, CANONICAL.format("http://example.org/es/1"), "allow", None),
    (6, "no address", "", "allow", None),
    # Aliases of a blocked page, by redirects of its own site and by links.
    (7, "https://x.com/de/a", "", "block", "com/de/"),
    (8, "https://y.net/1", CANONICAL.format("http://www.x.com/de/a.html?utm_source=q"), "block", None),
    (9, "http://z.net/2", '<meta http-equiv="refresh" content="0; url=https://y.net/1/">', "block", None),
    (10, "http://www.z.net/2.html#top", "", "block", None),
    (10, "http://www.z.net/2.html#top", "", "block", None),
    # A class with an allowed page is allowed.
    (11, "http://b.com/de/1", CANONICAL.format("http://c.com/fr/1"), "block", "com/de/"),
    (12, "http://c.com/fr/1", "", "allow", "com/fr/"),
    (13, "http://d.net/", CANONICAL.format("http://b.com/de/1"), "allow", None),
    (14, "http://com/fr/", "", "allow", "com/fr/"),
    (15, "http://xcom/fr/", "", "allow", None),
    (None, "http://q.com/de/", "", "block", "com/de/"),
    (16, "http://long.net/" + "a" * 50_000, "x" * 50_000, "allow", None),
    (17, "http://r.net/x", '<link rel=canonical href="/y">', "allow", None),
]


def test_verdicts(spark, plan):
    pages = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h, *_ in ROWS], SCHEMA)
    judged = judge_pages(pages)
    got = sorted((str(r.page_id), r.verdict, str(r.rule)) for r in judged.collect())
    assert got == sorted((str(i), verdict, str(rule)) for i, _, _, verdict, rule in ROWS)
    assert "Python" not in plan(judged) and "MapIn" not in plan(judged)


def test_hosts_and_paths(spark):
    pages = spark.createDataFrame([(i, u, h, "", "") for i, u, h, *_ in ROWS], SCHEMA)
    got = {r.page_id: (r.host, r.path) for r in judge_pages(pages).collect()}
    assert got[1] == ("sub.example.org", "/es/1") and got[3] == ("example.org", "")
    assert got[5] == ("", "") and got[6] == ("", "")


def test_redirect_table_and_precedence(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/", "", "", ""), (2, "http://b.net/", "", "", "")], SCHEMA)
    redirects = spark.createDataFrame([("http://b.net", "http://a.com/de/"), (None, "http://a.com/de/")], "source string, target string")
    assert {r.page_id: r.verdict for r in judge_pages(pages, redirects=redirects).collect()} == {1: "block", 2: "block"}


def test_empty_table(spark):
    assert judge_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_alias_keys(spark):
    urls = ["http://www.A.net/x/", "https://m.a.net/x.html#f", "http://a.net/x?utm_a=1&ref=2", "http://a.net/x?p=1"]
    keys = spark.createDataFrame([(u,) for u in urls], "u string").select(alias_key_of("u")).collect()
    assert [k[0] for k in keys] == ["a.net/x", "a.net/x", "a.net/x", "a.net/x?p=1"]


def alias_key_of(name):
    from pyspark.sql import functions as F

    return alias_key(F.col(name))


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
