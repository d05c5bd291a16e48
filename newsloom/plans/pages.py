"""Queries over the pages table: URLs, HTML, extraction, classification, frontier, robots, feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import dates, display, http, text, urls
from newsloom.operators import articles, crawl
from newsloom.session import table, texts
from newsloom.sources import feeds, robots
from newsloom.sources.extraction import page_graph

AS_OF = datetime(2024, 6, 1)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = urls.host("url")
    return pages(spark, sf_dir).select("page_id", h.alias("host"), urls.origin("url").alias("origin"), urls.registrable_domain(h).alias("domain"), urls.without_www(h).alias("bare_host"), urls.path("url").alias("path"))


def url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls.normalize_plain_url("url")
    return pages(spark, sf_dir).select("page_id", u.alias("normal"), urls.url_hash(u).alias("url_hash"))


def url_normalized_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the complete normaliser, with a query and a path that need it."""
    spoiled = F.concat(F.upper(F.substring("url", 1, 8)), F.expr("substring(url, 9)"))
    return pages(spark, sf_dir).select("page_id", urls.normalize_url(spoiled).alias("normal"))


def url_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _varied(F.col("url"), F.col("page_id"))
    return pages(spark, sf_dir).select("page_id", F.round(urls.article_url_score(u), 4).alias("score"))


def _varied(url: Column, n: Column) -> Column:
    """URLs with paths of several kinds."""
    at = F.concat(urls.origin(url), urls.path(url))
    forms = ["", "/2024/05/a-long-story-slug", "/a/b/a/b/a/b", "/tag/x", "/story-12345.html", "?PHPSESSID=1", "/x/x/x/x", "/photo.JPG", "?page=12345", "/a/b/c/a/b/c"]
    out = at
    for k, form in enumerate(forms):
        out = F.when(n % len(forms) == k, F.concat(at, F.lit(form))).otherwise(out)
    return out


_VARIED = """(SELECT page_id, a || CASE page_id % 10 WHEN 1 THEN '/2024/05/a-long-story-slug' WHEN 2 THEN '/a/b/a/b/a/b' WHEN 3 THEN '/tag/x' WHEN 4 THEN '/story-12345.html' WHEN 5 THEN '?PHPSESSID=1'
 WHEN 6 THEN '/x/x/x/x' WHEN 7 THEN '/photo.JPG' WHEN 8 THEN '?page=12345' WHEN 9 THEN '/a/b/c/a/b/c' ELSE '' END AS u FROM (SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*[^?#]*)', 1) AS a FROM pages))"""
_TRAP = """(SELECT *, list_filter(string_split(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS s, lower(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1)) AS q FROM {v}) v,
 LATERAL (SELECT coalesce(list_max(list_transform(s, lambda x: len(list_filter(s, lambda y: y = x)))), 0) AS m1) a,
 LATERAL (SELECT list_transform(range(1, len(s)), lambda i: s[i] || '/' || s[i + 1]) AS p2, list_transform(range(1, len(s) - 1), lambda i: s[i] || '/' || s[i + 1] || '/' || s[i + 2]) AS p3) b,
 LATERAL (SELECT coalesce(list_max(list_transform(p2, lambda x: len(list_filter(p2, lambda y: y = x)))), 0) AS m2, coalesce(list_max(list_transform(p3, lambda x: len(list_filter(p3, lambda y: y = x)))), 0) AS m3) c""".format(v=_VARIED)
_IS_TRAP = "(len(s) > 15 OR m1 > 3 OR m2 >= 3 OR m3 >= 3 OR regexp_matches(q, '(^|&)(phpsessid|jsessionid|sid|sessionid)=') OR regexp_matches(q, '(^|&)(page|p)=[0-9]{4,}'))"


def url_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _varied(F.col("url"), F.col("page_id"))
    return pages(spark, sf_dir).select("page_id", urls.has_trap_pattern(u).alias("trap"), urls.looks_like_non_html(u).alias("not_html"))


def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _varied(F.col("url"), F.col("page_id"))
    return pages(spark, sf_dir).select("page_id", urls.scope_reason(u, ["example.com", "example.net"], exclude=["/es/"]).alias("reason"))


def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which forms of the pages' URLs may be fetched: other schemes, credentials, ports, names and addresses."""
    n, h, rest = F.col("page_id"), urls.host("url"), F.concat(urls.path("url"), F.lit("?n="), F.col("page_id").cast("string"))
    ip = F.concat_ws(".", *((F.col("page_id") * k % 256).cast("string") for k in (37, 11, 5, 3)))
    made = [
        F.col("url"), F.concat(F.lit("ftp://"), h, rest), F.concat(F.lit("http://u:p@"), h, rest), F.concat(F.lit("https://"), h, F.lit(":22"), rest), F.concat(F.lit("http://"), h, F.lit(".internal"), rest),
        F.concat(F.lit("http://10."), (n % 200).cast("string"), F.lit(".0.7"), rest), F.concat(F.lit("http://[fe80::"), F.hex(n), F.lit("]"), rest), F.concat(F.lit("http://host"), n.cast("string"), rest), F.concat(F.lit("http://"), ip, rest),
    ]
    u = made[0]
    for k, form in enumerate(made):
        u = F.when(n % len(made) == k, form).otherwise(u)
    return pages(spark, sf_dir).select("page_id", urls.guard_reason(u).alias("reason"))


def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and headings by pattern, as they stand in the source."""
    return _heads(pages(spark, sf_dir)).select("page_id", "title", "h1", "lang")


def _heads(rows: DataFrame) -> DataFrame:
    get = lambda tag: F.regexp_extract("html", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return rows.select("page_id", "url", "html", get("title").alias("title"), get("h1").alias("h1"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


def page_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of links, paragraphs and scripts, the text's length without tags, and whether a script would have to draw the page."""
    # every other page as a shell that scripts fill
    n = F.col("page_id") % 4
    html = F.when(n == 1, F.concat(F.lit('<html><body><div class="x" id="root"></div>'), F.repeat(F.lit("<script src=a></script>"), (F.col("page_id") % 13).cast("int")), F.lit("</body></html>"))).when(
        n == 3, F.concat(F.lit("<html><body><p>"), F.repeat(F.lit("word "), (F.col("page_id") % 101).cast("int")), F.lit("</p><script>window.__INITIAL_STATE__ = {}</script></body></html>"))
    ).otherwise(F.col("html"))
    bare = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    count = lambda p: F.regexp_count("html", F.lit(p))
    shell = http.needs_script("shown", text.word_count(F.regexp_replace("shown", "<[^>]*>", " ")))
    return pages(spark, sf_dir).withColumn("shown", html).select("page_id", count("<a ").alias("links"), count("<p>").alias("paragraphs"), count("<script").alias("scripts"), bare.alias("text_chars"), F.contains("html", F.lit("<article>")).alias("has_article"), shell.alias("js_shell"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with candidates for title, body and language by pattern."""
    p = _heads(pages(spark, sf_dir))
    body = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1), "\n\n")
    teaser = F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1)
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    one = lambda field, value, conf, source, order: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(None).cast("array<string>").alias("values"), F.lit(conf).alias("confidence"), F.lit(source).alias("source"), F.lit(order).alias("ord"), words(value).alias("words"))
    rows = F.array(one("title", F.col("title"), 0.5, "tag", 0), one("title", F.col("h1"), 0.6, "heading", 1), one("body", teaser, 0.8, "teaser", 0), one("body", body, 0.6, "density", 1), one("language", F.col("lang"), 0.7, "html", 0))
    return p.select("page_id", "url", "html", F.filter(rows, lambda x: F.coalesce(x["value"], F.lit("")) != "").alias("candidates"))


_P = r"""(SELECT page_id, url, html, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h1, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
 regexp_extract(html, '<p>(.*?)</p>', 1, 's') AS teaser, array_to_string(regexp_extract_all(html, '<p>(.*?)</p>', 1, 's'), chr(10) || chr(10)) AS body FROM pages)"""
_W = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_BODY = f"""(SELECT *, {_W.format("teaser")} AS tw, {_W.format("body")} AS bw FROM {_P})"""
_BEST = f"""(SELECT *, coalesce(CASE WHEN teaser <> '' AND 0.8 * sqrt(least(1.0, tw / greatest(tw, bw, 1))) >= 0.6 * sqrt(least(1.0, bw / greatest(tw, bw, 1))) THEN 'teaser' END, CASE WHEN body <> '' THEN 'density' END) AS body_source FROM {_BODY})"""


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best title and body of each page and where they come from."""
    c = _candidates(spark, sf_dir).select("page_id", articles.merged("title").alias("t"), articles.merged("body").alias("b"))
    return c.select("page_id", F.col("t.source").alias("title_source"), F.col("b.source").alias("body_source"), F.col("b.words").alias("body_words"))


def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = {f: articles.merged(f) for f in articles.WEIGHTS}
    return _candidates(spark, sf_dir).select("page_id", F.round(articles.raw_confidence(best), 6).alias("confidence"))


def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article or not, by signals read off the source with patterns."""
    p = _candidates(spark, sf_dir)
    paragraphs = F.size(F.filter(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1), lambda x: F.length(x) > 60))
    signals = F.struct(F.lit(None).cast("string").alias("article_type"), (F.col("page_id") % 11 == 0).alias("is_listing"), F.when(F.col("page_id") % 2 == 0, F.lit("Article")).alias("og_type"), paragraphs.alias("paragraphs"), F.contains("html", F.lit("<article>")).alias("has_article_tag"), F.lit(None).cast("double").alias("link_density"))
    words = F.coalesce(articles.merged("body")["words"], F.lit(0))
    row = p.select("page_id", "url", words.alias("words"), signals.alias("signals"))
    terms = articles.score_terms(F.col("words"), F.col("signals"), F.col("page_id") % 3 == 0, F.lit(False), urls.article_url_score(F.col("url")))
    is_article, score, reasons = articles.classify(terms, F.col("words"), F.col("page_id") % 13 == 0)
    return row.select("page_id", is_article.alias("is_article"), score.alias("score"), F.size(reasons).alias("reasons"))


_SCORE_OF = """CASE WHEN p IN ('', '/') THEN 0.05 ELSE greatest(0.0, least(1.0, 0.3 + CASE WHEN regexp_matches(p, '/(19|20)[0-9]{{2}}[/-](0?[1-9]|1[0-2])([/-](0?[1-9]|[12][0-9]|3[01]))?(/|$|-)') THEN 0.35 ELSE 0 END
 + CASE WHEN length(slug) - length(replace(slug, '-', '')) >= 3 THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(p, '[0-9]{{5,}}') THEN 0.1 ELSE 0 END + CASE WHEN p LIKE '%.html' OR p LIKE '%.htm' THEN 0.05 ELSE 0 END
 - CASE WHEN regexp_matches(p, '(?i)/({listing})(/|$)') THEN 0.35 ELSE 0 END)) END""".format(listing="|".join(urls.LISTING))
_SCORED = "(SELECT *, regexp_extract(p, '([^/]+)/*$', 1) AS slug FROM (SELECT *, regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p FROM {t}))"
_CLASS = f"""WITH s AS (SELECT *, {_SCORE_OF} AS prior FROM {_SCORED.format(u="url", t=_BEST)}),
w AS (SELECT *, CASE body_source WHEN 'teaser' THEN tw WHEN 'density' THEN bw ELSE 0 END AS words, len(list_filter(regexp_extract_all(html, '<p>(.*?)</p>', 1, 's'), lambda x: length(x) > 60)) AS paras FROM s),
t AS (SELECT *, [CASE WHEN page_id % 11 = 0 THEN -0.25 END, CASE WHEN page_id % 2 = 0 THEN 0.2 END, CASE WHEN page_id % 3 = 0 THEN 0.15 END, CASE WHEN words >= 120 THEN 0.25 WHEN words >= 60 THEN 0.05 ELSE -0.2 END,
 CASE WHEN words >= 300 THEN 0.1 END, CASE WHEN paras >= 3 THEN 0.1 END, CASE WHEN contains(html, '<article>') THEN 0.05 END, CASE WHEN prior >= 0.5 THEN 0.1 WHEN prior <= 0.1 THEN -0.25 END] AS terms FROM w),
c AS (SELECT *, round(greatest(0.0, least(1.0, list_sum(terms))), 3) AS score FROM t)
SELECT page_id, score >= 0.5 AND words >= 30 AND page_id % 13 <> 0 AS is_article, CAST(score AS DOUBLE) AS score, CAST(len(list_filter(terms, lambda x: x IS NOT NULL)) + CASE WHEN words < 30 OR page_id % 13 = 0 THEN 1 ELSE 0 END AS INTEGER) AS reasons FROM c"""


def extract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows by all strategies, in one parse of each page."""
    return articles.extract_articles(pages(spark, sf_dir), AS_OF)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link graph of the pages."""
    return page_graph(pages(spark, sf_dir)).select("page_id", F.posexplode("links").alias("pos", "target"))


def frontier_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier in order of visit: of the first 5,000 URLs seen, the first hundred."""
    n = F.col("page_id")
    via = F.when(n % 4 == 0, "feed").when(n % 4 == 1, "sitemap").when(n % 4 == 2, "link").otherwise("seed")
    published = F.when(n % 3 == 0, F.lit(AS_OF) - F.make_interval(days=(n % 50).cast("int")))
    found = pages(spark, sf_dir).select(urls.normalize_plain_url("url").alias("url"), n.alias("seq"), F.round(crawl.priority(F.col("url"), via, published, AS_OF), 6).alias("prio"))
    return crawl.frontier(found).limit(100).select("url", "seq", "prio")


_PLAIN_URL = """(SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS normal
 FROM (SELECT *, regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g') AS path,
 list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT (regexp_matches(lower(p), '^({names})(=|$)') OR regexp_matches(lower(p), '^({heads})'))), lambda p: {{'k': split_part(p, '=', 1), 'v': split_part(p, '=', 2)}})), lambda s: s.k || '=' || s.v) AS kept FROM pages))""".format(
    names="|".join(urls.TRACKING), heads="|".join(urls.TRACKING_PREFIXES)
)


def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of a graph in which page n links to 2n + 1 and 2n + 2 and back to n // 3."""
    p = pages(spark, sf_dir).select("page_id")
    name = lambda n: F.concat(F.lit("https://example.com/p/"), n.cast("string"))
    n = F.col("page_id")
    links = p.select(name(n).alias("url"), F.explode(F.array(name(2 * n + 1), name(2 * n + 2), name((n / 3).cast("long")))).alias("target"))
    seeds = p.filter("page_id = 0").select(name(n).alias("url"))
    return crawl.crawl(seeds, links, 5, 200).select("url", "depth")


def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May each page be fetched, by one robots.txt for all hosts but those that fail or have none."""
    text = "User-agent: *\nDisallow: /es/\nDisallow: /*/1\nAllow: /es/2\nUser-agent: other\nDisallow: /\n"
    hosts = pages(spark, sf_dir).select(urls.origin("url").alias("origin")).distinct()
    status = F.when(F.col("origin").endswith("org"), 404).when(F.col("origin").contains("//m."), 503).otherwise(200)
    return robots.decide(pages(spark, sf_dir).select("page_id", "url"), hosts.select("origin", status.alias("status"), F.lit(text).alias("text")), "NewsloomBot/1.0 (+x)").select("page_id", "allowed")


def _xml(body: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return body


def sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL in a sitemap of its own, read back."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")), "yyyy-MM-dd")
    content = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), _xml(F.col("url")), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url></urlset>"))
    found = feeds.discover(pages(spark, sf_dir).select(content.cast("binary").alias("content"), F.col("page_id").cast("string").alias("base_url")), AS_OF)
    return found.select(F.col("base_url").cast("long").alias("page_id"), "via", F.col("url").alias("normal"), F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"))


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as an item of an RSS feed, read back."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")), "EEE, dd MMM yyyy")
    item = F.concat(F.lit("<rss><channel><item><title>T"), F.col("page_id").cast("string"), F.lit("</title><link>"), _xml(F.col("url")), F.lit("</link><pubDate>"), day, F.lit(" 08:30:00 GMT</pubDate></item></channel></rss>"))
    found = feeds.discover(pages(spark, sf_dir).select(item.cast("binary").alias("content"), F.lit("https://base.example/").alias("base_url")), AS_OF)
    return found.select("title", "via", F.col("url").alias("normal"), F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


#: What may be wrong with an entry, by page_id % 8: how its title is written, and the title that is read.
_SPOILED = {
    0: ("<title>T{}</title>", "T{}"),
    1: ("<title>T{} & co</title>", "T{} & co"),
    2: ("<title>T{}&nbsp;&unheardof;</title>", "T{}\u00a0&unheardof;"),
    3: ("<title>T{}", "T{}"),
    4: ("<title><b>T{}</title></b>", "T{}"),
    5: ("<title>T{} < 9</title>", "T{} < 9"),
    6: ("</p><title>T{}</title></title>", "T{}"),
    7: ("<TITLE lang=en x='y\">T{}</Title >", "T{}"),
}


def _spoiled(way: int, n: Column) -> Column:
    """One of the two texts of _SPOILED for each n."""
    out = F.lit(None)
    for k, texts_ in _SPOILED.items():
        head, tail = texts_[way].split("{}")
        out = F.when(n % len(_SPOILED) == k, F.concat(F.lit(head), n.cast("string"), F.lit(tail))).otherwise(out)
    return out


def _hundreds(rows: DataFrame, entry: Column, head: str, tail: str) -> DataFrame:
    """A document of each hundred pages, entries in the order of their ids: (base_url, content)."""
    told = F.sort_array(F.collect_list(F.struct("page_id", entry.alias("entry"))))
    made = rows.groupBy(F.expr("page_id div 100").alias("hundred")).agg(F.array_join(F.transform(told, lambda e: e["entry"]), "").alias("body"))
    return made.select(F.col("hundred").cast("string").alias("base_url"), F.concat(F.lit(head), "body", F.lit(tail)).cast("binary").alias("content"))


def broken_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of a hundred entries, of which seven in eight aren't well-formed: every entry is read, in order."""
    n = F.col("page_id")
    end = F.when(n % 3 == 1, F.lit("")).otherwise(F.lit("</item>"))
    page = F.regexp_replace("url", "#.*$", "")
    mark = F.when(F.contains(page, F.lit("?")), F.lit("&amp;")).otherwise(F.lit("?"))
    entry = F.concat(F.lit("<item>"), _spoiled(0, n), F.lit("<link>"), _xml(page), mark, F.lit("a=1&copy=2</link>"), end)
    made = _hundreds(pages(spark, sf_dir), entry, '<?xml version="1.0"><rss><channel><title>All & none</title>', "</rss>")
    found = feeds.discover(made, AS_OF)
    return found.select(F.col("base_url").cast("long").alias("hundred"), "pos", "title", (F.col("url").rlike("[?&]a=1(&|$)") & F.col("url").rlike("[?&]copy=2(&|$)")).alias("whole_url"))


def broken_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of a hundred entries with bare ampersands, missing ends and crossed tags."""
    n = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 90).cast("int")), "yyyy-MM-dd")
    loc = F.concat(F.lit("https://m.example/"), n.cast("string"), F.lit("?a=1&reg=2"))
    entry = (
        F.when(n % 4 == 0, F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>")))
        .when(n % 4 == 1, F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), day))
        .when(n % 4 == 2, F.concat(F.lit("<url><loc>"), loc, F.lit("<lastmod>"), day, F.lit("</loc></url>")))
        .otherwise(F.concat(F.lit("</loc><url><wrap><LOC>"), loc, F.lit("</wrap></LOC><lastmod>"), day, F.lit("</lastmod></url></url>")))
    )
    found = feeds.discover(_hundreds(pages(spark, sf_dir), entry, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"), AS_OF)
    return found.select(F.col("base_url").cast("long").alias("hundred"), "pos", "url", "via", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in several ways, read back; implausible ones are NULL."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    n = F.col("o_orderkey") % 6
    written = (
        F.when(n == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(n == 1, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(n == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n == 3, F.unix_timestamp("ts").cast("string"))
        .when(n == 4, (F.unix_timestamp("ts") * 1000).cast("string"))
        .otherwise(F.date_format("ts", "MMMM d, yyyy"))
    )
    parsed = dates.parse_date(written, F.lit(datetime(1998, 1, 1)))
    return o.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd").alias("day"))


def stored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored twice, compressed; the newer source is read back."""
    p = pages(spark, sf_dir)
    raw = p.select(F.col("page_id").alias("id"), (F.col("page_id") % 50).alias("article_id"), http.gzip_text("html").alias("content"))
    return http.newest_source(raw).select("article_id", F.sha2("html", 256).alias("html_sha256"))


def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML or not, by declared types and by content."""
    n = F.col("page_id") % 3
    declared = F.when(n == 0, "text/html; charset=utf-8").when(n == 1, "application/pdf")
    return pages(spark, sf_dir).select("page_id", http.is_html(declared, "html").alias("is_html"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pause before each of a page's retries, and in words."""
    p = pages(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("attempt"))
    pause = http.backoff_seconds("attempt", (F.col("page_id") % 5) / 4)
    return p.select("page_id", "attempt", F.round(pause, 4).alias("seconds"), display.duration(pause * 100).alias("shown"))


_HOST = "lower(regexp_replace(regexp_extract(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^(?:.*@)?([^:]*)', 1), '\\.+$', ''))"
_LAST = "array_to_string(list_slice(string_split({h}, '.'), greatest(len(string_split({h}, '.')) - {n} + 1, 1), len(string_split({h}, '.'))), '.')"
_DOMAIN = "CASE WHEN {two} IN ({names}) THEN {three} ELSE {two} END".format(two=_LAST.format(h=_HOST, n=2), three=_LAST.format(h=_HOST, n=3), names=", ".join(f"'{x}'" for x in urls.TWO_LEVEL))
_NOT_HTML = "coalesce(regexp_extract(regexp_extract(lower(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), '([^/]*)$', 1), '[^.].*\\.([^.]*)$', 1) IN ({}), false)".format(", ".join(f"'{x}'" for x in urls.NOT_PAGES))

QUERIES = {
    "url_parts": (
        url_parts,
        f"SELECT page_id, {_HOST} AS host, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS origin, {_DOMAIN} AS domain, regexp_replace({_HOST}, '^www\\.', '') AS bare_host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM pages",
    ),
    "url_normalized": (url_normalized, f"SELECT page_id, normal, sha256(normal) AS url_hash FROM {_PLAIN_URL}"),
    "url_normalized_full": (url_normalized_full, f"SELECT page_id, normal FROM {_PLAIN_URL}"),
    "url_scores": (url_scores, f"SELECT page_id, CAST(round({_SCORE_OF}, 4) AS DOUBLE) AS score FROM {_SCORED.format(u='u', t=_VARIED)}"),
    "url_traps": (url_traps, f"SELECT page_id, {_IS_TRAP} AS trap, {_NOT_HTML} AS not_html FROM {_TRAP}"),
    "url_scope": (
        url_scope,
        f"""SELECT page_id, CASE WHEN NOT regexp_matches(u, '^(http|https)://') THEN 'scheme' WHEN length(u) > 2048 THEN 'too_long' WHEN NOT regexp_matches(lower(regexp_extract(u, '^[^:/?#]+://([^/?#:]*)', 1)), '(^|\\.)example\\.(com|net)$') THEN 'off_site'
 WHEN {_NOT_HTML} THEN 'non_html' WHEN {_IS_TRAP} THEN 'trap' WHEN contains(u, '/es/') THEN 'excluded' END AS reason FROM {_TRAP}""",
    ),
    "url_guard": (
        url_guard,
        """SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'scheme' WHEN 2 THEN 'credentials' WHEN 3 THEN 'port' WHEN 4 THEN 'internal_name' WHEN 5 THEN 'private_address' WHEN 6 THEN 'private_address' WHEN 7 THEN 'single_label'
 WHEN 8 THEN CASE WHEN a IN (0, 10, 127) OR a >= 224 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND b IN (18, 19) OR a = 198 AND b = 51 AND c = 100 OR a = 203 AND b = 0 AND c = 113
 OR a = 192 AND b = 88 AND c = 99 THEN 'private_address' END END AS reason FROM (SELECT page_id, page_id * 37 % 256 AS a, page_id * 11 % 256 AS b, page_id * 5 % 256 AS c FROM pages)""",
    ),
    "page_heads": (page_heads, f"SELECT page_id, title, h1, lang FROM {_P}"),
    "page_shape": (
        page_shape,
        """SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs, CAST(len(regexp_extract_all(html, '<script')) AS INTEGER) AS scripts, CAST(n AS INTEGER) AS text_chars,
 contains(html, '<article>') AS has_article, CASE page_id % 4 WHEN 1 THEN true WHEN 3 THEN page_id % 101 < 47 ELSE false END AS js_shell FROM (SELECT *, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages)""",
    ),
    "merge_candidates": (
        merge_candidates,
        f"SELECT page_id, CASE WHEN h1 <> '' THEN 'heading' WHEN title <> '' THEN 'tag' END AS title_source, body_source, CAST(CASE body_source WHEN 'teaser' THEN tw WHEN 'density' THEN bw END AS INTEGER) AS body_words FROM {_BEST}",
    ),
    "page_confidence": (
        page_confidence,
        f"""SELECT page_id, round(least(1.0, 0.2 * CASE WHEN h1 <> '' THEN 0.6 WHEN title <> '' THEN 0.5 ELSE 0 END + coalesce(0.35 * CASE body_source WHEN 'teaser' THEN 0.8 * least(1.0, tw / 120.0) WHEN 'density' THEN 0.6 * least(1.0, bw / 120.0) END, 0)
 + CASE WHEN lang <> '' THEN 0.05 * 0.7 ELSE 0 END), 6) AS confidence FROM {_BEST}""",
    ),
    "classify_pages": (classify_pages, _CLASS),
    "extract_articles": (extract_articles, None),
    "page_links": (page_links, None),
    "frontier_top": (
        frontier_top,
        f"""WITH s AS (SELECT *, {_SCORE_OF} AS score FROM {_SCORED.format(u="url", t=_PLAIN_URL)}),
f AS (SELECT normal AS url, page_id AS seq, round(CASE WHEN page_id % 4 = 3 THEN 0.5 ELSE CASE page_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN greatest(0.0, 1 - (page_id % 50) / 30.0) * 0.5 ELSE 0 END + score END, 6) AS prio FROM s),
o AS (SELECT url, min(seq) AS seq, arg_min(prio, seq) AS prio FROM f GROUP BY url ORDER BY seq LIMIT 5000) SELECT url, seq, prio FROM o ORDER BY prio DESC, seq LIMIT 100""",
    ),
    "crawl_levels": (
        crawl_levels,
        """WITH RECURSIVE e AS (SELECT page_id AS n, unnest([2 * page_id + 1, 2 * page_id + 2, page_id // 3]) AS t FROM pages), r AS (SELECT CAST(0 AS BIGINT) AS n, 0 AS d UNION SELECT e.t, d + 1 FROM r JOIN e USING (n) WHERE d < 5),
m AS (SELECT n, min(d) AS depth FROM r GROUP BY n) SELECT 'https://example.com/p/' || n AS url, depth FROM m ORDER BY depth, CASE WHEN regexp_matches(CAST(n AS VARCHAR), '[0-9]{5,}') THEN 1 ELSE 0 END DESC, url LIMIT 200""",
    ),
    "robots_decisions": (
        robots_decisions,
        """WITH p AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS o, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1) AS t FROM pages)
SELECT page_id, CASE WHEN o LIKE '%org' THEN true WHEN contains(o, '//m.') THEN false WHEN regexp_matches(t, '^/es/2') THEN true WHEN regexp_matches(t, '^/es/') OR regexp_matches(t, '^/.*/1') THEN false ELSE true END AS allowed FROM p""",
    ),
    "sitemap_rows": (sitemap_rows, f"SELECT page_id, 'sitemap' AS via, normal, strftime(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER), '%Y-%m-%d') AS lastmod FROM {_PLAIN_URL}"),
    "broken_feeds": (
        broken_feeds,
        f"""SELECT page_id // 100 AS hundred, CAST(row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS INTEGER) AS pos, CASE page_id % 8 {" ".join(f"WHEN {k} THEN '{told.split('{}')[0]}' || page_id || '{told.split('{}')[1]}'" for k, (_, told) in _SPOILED.items())} END AS title,
 true AS whole_url FROM pages""",
    ),
    "broken_sitemaps": (
        broken_sitemaps,
        """SELECT page_id // 100 AS hundred, CAST(row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS INTEGER) AS pos, 'https://m.example/' || page_id || '?a=1&reg=2' AS url, 'sitemap' AS via,
 strftime(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER), '%Y-%m-%d') AS lastmod FROM pages""",
    ),
    "feed_rows": (feed_rows, f"SELECT 'T' || page_id AS title, 'feed' AS via, normal, strftime(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER), '%Y-%m-%d') || ' 08:30' AS published FROM {_PLAIN_URL}"),
    "date_forms": (date_forms, "SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-03' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"),
    "stored_sources": (stored_sources, "SELECT page_id % 50 AS article_id, sha256(arg_max(html, page_id)) AS html_sha256 FROM pages GROUP BY 1"),
    "content_kinds": (content_kinds, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html)') END AS is_html FROM pages"),
    "retry_schedule": (
        retry_schedule,
        """SELECT page_id, attempt, round(s, 4) AS seconds, CASE WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE (t // 3600) || 'h ' || (t // 60 % 60) || 'm' END AS shown
FROM (SELECT *, CAST(floor(s * 100) AS BIGINT) AS t FROM (SELECT page_id, attempt, least(30.0, 0.5 * pow(2.0, attempt - 1)) * (0.5 + (page_id % 5) / 4 / 2) AS s FROM pages, (SELECT unnest(range(1, 9))::INTEGER AS attempt)))""",
    ),
}
