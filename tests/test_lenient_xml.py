import time
from datetime import UTC, datetime

import pytest

from newsloom.sources import feeds, lenient_xml

AS_OF = datetime(2024, 6, 1, tzinfo=UTC)
BASE = "https://w.example/"


def feed(*items):
    return ("<?xml version='1.0'?><rss><channel>" + "".join(items) + "</channel></rss>").encode()


def item(i, title=None, end="</item>"):
    return f"<item><title>{title or f'T{i}'}</title><link>/{i}</link>{end}"


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Salt & pepper", "Salt & pepper"),
        ("AT&T", "AT&T"),
        ("a&nbsp;b", "a\xa0b"),
        ("&unheardof; x &#233; &#xE9; &amp;amp;", "&unheardof; x é é &amp;"),
        ("x < 5 and y<6", "x < 5 and y<6"),
        ("<b>bold</title></b>", "bold"),
        ("<![CDATA[a <b> & c]]> d", "a <b> & c d"),
        ("one<!-- no -->two", "onetwo"),
        ("</p>stray", "stray"),
        ("tab</title >", "tab"),
    ],
)
def test_one_bad_title_spoils_no_other(title, want):
    got = feeds.parse_feed(feed(item(0), item(1, title), item(2)), BASE, AS_OF)
    assert [(r[0], r[2]) for r in got] == [(f"{BASE}0", "T0"), (f"{BASE}1", want), (f"{BASE}2", "T2")]


@pytest.mark.parametrize(
    "bad",
    [
        item(1, end=""),
        "<item><title>T1<link>/1</link></item>",
        "<item><title>T1</title><link>/1</item>",
        "<item><title>T1</title></title><link>/1</link></item></item>",
        "<item class=x y ><title lang='a\" >T1</title><link>/1</link></item>",
        "<ITEM><Title>T1</TITLE><LINK>/1</LINK></Item>",
        "<item><group><title>T1</title><link>/1</group></link></item>",
        "<item><title>T1</title><link rel=alternate href=/1 /></item>",
        "<item><title>T1</title><?php x ><link>/1</link></item>",
    ],
)
def test_broken_nesting(bad):
    got = feeds.parse_feed(feed(item(0), bad, item(2)), BASE, AS_OF)
    assert [(r[0], r[2]) for r in got] == [(f"{BASE}{i}", f"T{i}") for i in range(3)]


def test_bare_ampersands_in_sitemaps():
    for spoiled in ("<loc>/a?x=1&copy=2&sect;ion=3</loc>", "<loc>/a?x=1&amp;copy=2&sect;ion=3</loc>"):
        content = f"<urlset><url><loc>/0</loc></url><url>{spoiled}<lastmod>2024-05-04</lastmod></url><url><loc>/2</loc></url></urlset>".encode()
        got = feeds.parse_sitemap(content, BASE, AS_OF)
        assert [r[0] for r in got][::2] == [f"{BASE}0", f"{BASE}2"] and "copy=2" in got[1][0] and got[1][4].day == 4


def test_sitemap_nesting():
    content = b"<?xml version='1.0'><urlset xmlns:i='x'><url><loc>/0</loc><url><loc>/1<lastmod>2024-05-04</lastmod></url></loc><url><i:image><i:loc>/img</i:loc></i:image></url></urlset><url><loc>/3</loc></url>"
    got = feeds.parse_sitemap(content, BASE, AS_OF)
    assert [(r[0], r[4] and r[4].day) for r in got] == [(f"{BASE}0", None), (f"{BASE}1", 4), (f"{BASE}img", None), (f"{BASE}3", None)]
    other = b"<urlset><page><loc>/0</loc></page><!-- <url><loc>/no</loc></url> --><url><loc>/1</loc></url>"
    assert [r[0] for r in feeds.parse_sitemap(other, BASE, AS_OF)] == [f"{BASE}0", f"{BASE}1"]


def test_character_sets():
    body = "<rss><item><title>Köln – é</title><link>/1</link></item></rss>"
    for name in ("utf-8", "iso-8859-15", "utf-16", "utf-8-sig", "windows-1252"):
        declared = "" if name in ("utf-16", "utf-8-sig") else f'<?xml version="1.0" encoding="{name}"?>'
        text = body.replace(" – ", " ") if name == "iso-8859-15" else body
        (row,) = feeds.parse_feed((declared + text).encode(name), BASE, AS_OF)
        assert row[2] == ("Köln é" if name == "iso-8859-15" else "Köln – é")
    assert feeds.parse_feed('<?xml encoding="nonsense"?>'.encode() + body.encode(), BASE, AS_OF)[0][2] == "Köln – é"


@pytest.mark.parametrize("cut", range(0, 128, 3))
def test_cut_off_anywhere(cut):
    whole = feed(item(0), item(1, "a &amp; b"), item(2))
    got = feeds.parse_feed(whole[: len(whole) - cut], BASE, AS_OF)
    assert [r[0] for r in got][:1] == [f"{BASE}0"] and len(got) >= 1


@pytest.mark.parametrize("text", ["<" * 50_000, "<a " + '"' * 50_000, "<a " + "'\"" * 20_000 + "<", "<!-- " * 5000, "<![CDATA[" * 5000, "<a>" * 20_000, "&" * 50_000, "<!DOCTYPE " + "[" * 20_000, "<item>" * 5000, "</item>" * 5000])
def test_time_and_end(text):
    began = time.perf_counter()
    list(lenient_xml.entries(text, lambda name, _: name == "item"))
    assert time.perf_counter() - began < 10


def test_entities_stay_refused():
    assert feeds.parse_feed(b'<!DOCTYPE x [<!ENTITY a "b">]>' + feed(item(0)), BASE, AS_OF) == []
