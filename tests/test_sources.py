import gzip
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from newsloom.sources import feeds, robots

AS_OF = datetime(2024, 6, 1, tzinfo=UTC)
BASE = "https://n.example/"
RSS = b"""<?xml version="1.0"?><rss version="2.0"><channel><title>N</title><item><title>One &amp; all</title><link>https://n.example/one?utm_medium=rss</link><pubDate>Sun, 19 May 2024 21:05:00 GMT</pubDate></item>
<item><link>/two</link><guid>g</guid></item><item><title>none</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>E</title><link rel="self" href="/self"/><link href="/e"/><id>urn:1</id><updated>2024-05-01T00:00:00Z</updated></entry></feed>"""
JSON = b'  {"version": "https://jsonfeed.org/version/1", "items": [{"url": "/j", "title": "J", "date_published": "2024-05-02"}, {"external_url": "https://x.example/k"}, {"id": 1}]}'
INDEX = b"""<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>/s1.xml</loc><lastmod>2024-05-01</lastmod></sitemap></sitemapindex>"""
NEWS = b"""<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>/a</loc><n:news><n:publication_date>2024-05-03</n:publication_date><n:title>A</n:title></n:news></url>
<url><loc>/b</loc><lastmod>2024-05-04</lastmod></url><url><loc> </loc></url></urlset>"""
BOMB = b'<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><rss><channel><item><link>/x</link></item></channel></rss>'


def test_feeds():
    one, two = feeds.parse_feed(RSS, BASE, AS_OF)
    assert one[:3] == ("https://n.example/one", "feed", "One & all") and one[3] == datetime(2024, 5, 19, 21, 5, tzinfo=UTC)
    assert two[0] == "https://n.example/two"
    assert [(r[0], r[3].day) for r in feeds.parse_feed(ATOM, BASE, AS_OF)] == [("https://n.example/e", 1)]
    assert [r[0] for r in feeds.parse_feed(JSON, BASE, AS_OF)] == ["https://n.example/j", "https://x.example/k"]
    assert feeds.parse_feed(RSS[:-40], BASE, AS_OF)[0][0] == one[0]  # cut off
    assert feeds.parse_feed(b"{bad", BASE, AS_OF) == feeds.parse_feed(b"", BASE, AS_OF) == []


def test_sitemaps():
    assert [(r[0], r[1], r[4].day) for r in feeds.parse_sitemap(INDEX, BASE, AS_OF)] == [("https://n.example/s1.xml", "sitemap-index", 1)]
    a, b = feeds.parse_sitemap(NEWS, BASE, AS_OF)
    assert a[:3] == ("https://n.example/a", "sitemap", "A") and a[3].day == 3 and b[4].day == 4


def test_entities_are_refused(spark):
    assert feeds.parse_feed(BOMB, BASE, AS_OF) == feeds.parse_sitemap(BOMB, BASE, AS_OF) == []
    df = spark.createDataFrame([(BOMB, ""), (RSS, "text/xml"), (NEWS, ""), (JSON, ""), (b"<html>", "application/atom+xml")], "c binary, t string")
    rows = df.select(feeds.has_entities(F.col("c")), feeds.is_feed(F.col("c"), F.col("t")), feeds.is_sitemap(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, False), (False, True, False), (False, False, True), (False, True, False), (False, True, False)]


def test_discover(spark):
    docs = spark.createDataFrame([(gzip.compress(NEWS), BASE), (RSS, BASE), (None, BASE), (b"\x1f\x8bbad", BASE)], "content binary, base_url string")
    got = feeds.discover(docs, AS_OF).orderBy("via", "pos").collect()
    assert [(r.via, r.pos, r.url) for r in got] == [("feed", 0, "https://n.example/one"), ("feed", 1, "https://n.example/two"), ("sitemap", 0, "https://n.example/a"), ("sitemap", 1, "https://n.example/b")]


def test_bytes():
    assert feeds.gunzip(gzip.compress(b"x" * 100), 100) == b"x" * 100
    with pytest.raises(ValueError, match="too large"):
        feeds.gunzip(gzip.compress(b"x" * 101), 100)
    assert feeds.decode_text('<meta charset="iso-8859-1">café'.encode("latin-1")) == '<meta charset="iso-8859-1">café'
    assert feeds.decode_text("é".encode(), "no-such-set") == "é" and feeds.decode_text(b"\xff") == "�"


RULES = """# made for tests
sitemap: https://r.example/all.xml
USER-AGENT: Loomer
user-agent: *
allow: /files/*.txt$
disallow: /files
crawl-delay: 0.5
crawl-delay: soon
User-Agent: Grabber/3
Allow: news
Disallow: *
Disallow:
no colon here
"""


def test_parse_robots():
    rules, delays, sitemaps = robots.parse_robots(RULES)
    assert [r[1:] for r in rules if r[0] == 0] == [("loomer", True, ""), ("*", True, ""), ("loomer", True, "/files/*.txt$"), ("*", True, "/files/*.txt$"), ("loomer", False, "/files"), ("*", False, "/files")]
    assert [r[1:] for r in rules if r[0] == 1] == [("grabber/3", True, ""), ("grabber/3", True, "/news"), ("grabber/3", False, "*")]
    assert (delays, sitemaps) == ({0: 0.5}, ["https://r.example/all.xml"])
    assert robots.product_token(" Loomer/2.1 beta") == "loomer"
    assert robots.parse_robots("disallow: /before any agent") == ([], {}, [])


AT = "https://r.example"
STATES = [(AT, 200, RULES), ("https://busy.example", 429, RULES), ("https://gone.example", 410, RULES), ("https://silent.example", None, None), ("https://empty.example", 204, None)]


@pytest.mark.parametrize(
    ("agent", "want"),
    [
        ("Loomer", {f"{AT}/files/a": False, f"{AT}/files/a.txt": True, f"{AT}/files/a.txt?v=2": False, f"{AT}": True, f"{AT}/filesystem": False}),
        ("anyone/9", {f"{AT}/files": False, f"{AT}/robots.txt": True, "https://busy.example/robots.txt": False, "https://gone.example/files": True, "https://silent.example/": False, "https://empty.example/files": True, "https://new.example/files": True}),
        ("grabber/3", {f"{AT}/news/1": True, f"{AT}/files/%61.txt": True, f"{AT}/files/%61.doc": False}),
    ],
)
def test_decisions(spark, agent, want):
    table = spark.createDataFrame(STATES, "origin string, status int, text string")
    pages = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.allowed for r in robots.decide(pages, table, agent).collect()} == want


def test_tie_allows(spark):
    table = spark.createDataFrame([("https://n.example", 200, "User-agent: *\nDisallow: /a\nAllow: /a\n")], "origin string, status int, text string")
    assert robots.decide(spark.createDataFrame([("https://n.example/a",)], "url string"), table, "x").first().allowed
