"""Queries of the article store's smaller parts: cleaning, extraction from made-up pages, runs, workspaces, pages, listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import display, http, text, urls
from newsloom.operators import articles, crawl, stats
from newsloom.session import cut, table, texts
from newsloom.sources import extraction

AS_OF = datetime(2024, 6, 1)


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("workspace_id"), F.col("c_mktsegment").alias("segment"))


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _n(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# cleaning


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in markup, with references and odd spaces, cleaned as a text and as a body."""
    raw = _say(" <b>", F.col("name"), "</b>\t&amp;&nbsp; more&#33;  \n\n\n\n x &lt;  y \n")
    return _suppliers(spark, sf_dir).select("id", text.clean_text(raw).alias("as_text"), text.clean_body(raw).alias("as_body"))


def author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bylines taken apart into names."""
    lines = F.array(_say("By Ann ", F.col("name"), " and Bo Li"), _say("von Eva, Jon ;"), F.lit("www.site.example"), F.lit("X"), _say("Bo Li & ", F.col("name")))
    return _suppliers(spark, sf_dir).select("id", F.array_join(text.clean_authors(lines), "|").alias("authors"))


def site_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without the site's name, and names of workspaces."""
    k = F.col("id") % 4
    title = F.when(k == 0, _say("Story | ", F.col("name"))).when(k == 1, _say("Story - ", F.col("name"), " ")).when(k == 2, F.col("name")).otherwise(_say("Story about ", F.col("name"), " now"))
    mail = _say(F.when(k == 3, "").otherwise("first.last_"), _n("id"), "@mail.example")
    return _suppliers(spark, sf_dir).select(
        "id", text.strip_site_name(title, F.col("name")).alias("title"), text.workspace_name(_say("  a \t b ", _n("id"), "\n")).alias("workspace"), text.personal_name(mail).alias("personal"),
        text.is_email(F.when(k == 1, _say(F.col("name"), "@x.y")).otherwise(mail)).alias("is_email"),
    )


def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and shares as people read them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    ago = F.col("id") * 977 % 4_000_000 - 200_000
    return o.select("id", display.relative_time(F.timestamp_seconds(F.lit(1717200000) - ago), F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("shown"), display.percent(F.col("id") % 101 / 100).alias("share"), display.duration(F.col("id") % 9000).alias("took"))


def public_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses are public: of both versions, embedded, reserved and malformed ones."""
    n = F.col("id")
    # parts of addresses stay in their range for ids of any size
    last, group = _n(F.pmod(n, F.lit(200)) + 1), F.hex(F.pmod(n, F.lit(1 << 16)))
    forms = [_say("8.8.4.", last), _say("10.1.2.", last), _say("192.168.0.", last), _say("100.64.0.", last), _say("100.128.0.", last), _say("::ffff:127.0.0.", last), _say("::ffff:9.9.9.", last), _say("2606:4700::", group), _say("fd00::", group), _say("999.1.1.", last)]
    # ids below zero have no form but the first: a private one
    ip = forms[1]
    for k, form in enumerate(forms):
        ip = F.when(n % 10 == k, form).otherwise(ip)
    return _customers(spark, sf_dir).select("id", urls.is_public_ip(ip).alias("public"))


# extraction


def _page(head: Column, body: Column) -> Column:
    return _say('<!doctype html><html lang="en-GB"><head>', head, "</head><body>", body, "</body></html>")


def _made(rows: DataFrame, head: Column, body: Column) -> DataFrame:
    url = _say("https://www.site", _n(F.col("id") % 9), ".example/2024/05/a-story-of-", _n("id"))
    return rows.select(F.col("id").alias("page_id"), url.alias("url"), _page(head, body).alias("html"))


def _paragraphs(word: str, words: int) -> Column:
    """As many paragraphs as the id's remainder by seven says, each of so many words."""
    one = _say("<p>", F.repeat(F.lit(f"{word} "), words - 1), f"{word}.</p>")
    return F.repeat(one, (F.col("id") % 7).cast("int"))


def linked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from pages with linked data and text."""
    i = _n("id")
    thing = _say(
        '{"@graph": [{"@type": "WebSite", "name": "Site"}, {"@type": ["NewsArticle"], "headline": "Story &amp; more ', i, '", "author": [{"name": "Ann A', i, '"}, "Bo Li"], "datePublished": "2024-05-', F.lpad(_n(F.col("id") % 28 + 1), 2, "0"),
        'T10:00:00Z", "keywords": "k', _n(F.col("id") % 5), ', common", "articleSection": "S', _n(F.col("id") % 3), '", "image": {"url": "/i/', i, '.png"}, "publisher": {"name": "The Site"},}]}',
    )
    made = _made(_suppliers(spark, sf_dir), _say('<script type="application/ld+json">', thing, "</script>"), _say("<nav><a href='/'>Home</a></nav><article>", _paragraphs("word", 30), "</article>"))
    out = articles.extract_articles(made, AS_OF)
    return out.select(
        "page_id", "title", F.array_join("authors", "|").alias("authors"), F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"), F.array_join("tags", "|").alias("tags"), "category", "image_url", "site_name", "language",
        "word_count", "is_article", "primary_method", "used_fallback",
    )


def meta_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from pages with meta tags, whose canonical address is on the site or on another."""
    i, k = _n("id"), F.col("id") % 3
    head = _say(
        "<title>Tab</title>", F.when(k != 0, _say('<meta property="og:title" content="Story ', i, ' | The Site">')).otherwise(""), '<meta name="author" content="By Ann A', i, ' and Bo Li"><meta name="application-name" content="The Site">',
        '<meta property="article:tag" content="t', _n(F.col("id") % 4), ';u"><meta name="description" content=" a  b ">', F.when(k == 1, _say('<link rel="canonical" href="/c/', i, '?utm_source=x">')).when(k == 2, '<link rel="canonical" href="https://other.test/x">').otherwise(""),
        F.when(F.col("id") % 5 == 0, '<meta name="robots" content="NoIndex, follow">').otherwise(""),
    )
    made = _made(_suppliers(spark, sf_dir), head, _say("<h1>Heading ", i, "</h1><main>", _paragraphs("text", 40), "</main>"))
    out = articles.extract_articles(made, AS_OF)
    return out.select("page_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("tags", "|").alias("tags"), "description", "canonical_url", "external_canonical", "noindex", "nofollow", "is_article", F.element_at("field_sources", "title").alias("title_from"))


def page_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, feeds and directives of made-up pages."""
    i = _n("id")
    head = _say('<base href="/b/"><link rel="alternate" type="application/rss+xml" href="/feed', i, '.xml"><meta name="newsloom-x" content="noarchive"><meta name="robots" content="none">')
    body = _say('<a href="p', i, '?utm_id=1">a</a><a href="../q#f">b</a><a rel="nofollow" href="/n">c</a><a href="x.pdf">d</a><a href="p', i, '">e</a><a href="mailto:a@b.example">f</a><a href="//o', i, '.example">g</a>')
    made = extraction.page_graph(_made(_suppliers(spark, sf_dir), head, body))
    return made.select("page_id", F.array_join("links", " ").alias("links"), F.array_join("feeds", " ").alias("feeds"), F.array_join("directives", ",").alias("directives"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and addresses of the pages' articles."""
    out = articles.extract_articles(texts(spark, sf_dir, "pages"), AS_OF)
    return out.select("page_id", "language", F.size("authors").alias("authors"), F.col("published_at").isNull().alias("undated"), "noindex", "used_fallback")


def page_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a debug report says of each page: its strategies, feeds, and whether it has fingerprints."""
    told = F.from_json("trace", "candidates array<struct<strategy string, field string, value string>>, fingerprints struct<content_hash string, simhash string>, links array<string>, feeds array<string>, errors map<string,string>")
    out = articles.trace(extraction.extract_candidates(texts(spark, sf_dir, "pages"), AS_OF)).select("page_id", told.alias("t"))
    longest = F.array_max(F.transform("t.candidates", lambda c: F.length(c["value"])))
    return out.select("page_id", (longest <= 500).alias("clipped"), F.coalesce(F.length("t.fingerprints.content_hash"), F.lit(0)).alias("hash_chars"), (F.size("t.links") <= 100).alias("few_links"), F.coalesce(F.size("t.feeds"), F.lit(0)).alias("feeds"))


# runs and pages


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits of runs: an hour is a run."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    kind = F.col("event_type")
    result = F.when(kind == "view", crawl.FETCHED).when(kind == "click", crawl.NOT_MODIFIED).when(kind == "purchase", crawl.HTTP_ERROR).when(kind == "error", crawl.NETWORK_ERROR).otherwise(crawl.SKIPPED)
    run = F.floor(F.unix_timestamp("ts") / 86400)
    names = F.array(*(F.lit(x) for x in ("new", "updated", "unchanged", "duplicate", "near_duplicate")))
    return e.select(
        run.alias("run"), F.col("event_id").alias("seq"), _say("u", _n("event_id")).alias("url"), _say("h", _n(F.col("user_id") % 7)).alias("host"), (F.col("event_id") % 10 == 0).alias("seed"), result.alias("result"),
        F.when(kind == "view", F.get(names, F.col("event_id") % 5)).alias("article"), F.when(kind.isin("purchase", "error"), kind).alias("error"), (F.col("event_id") % 4 == 0).alias("rendered"), (F.col("event_id") % 3).cast("int").alias("llm_calls"),
        F.lit(2).alias("discovered"), ((result == crawl.SKIPPED) & (F.col("user_id") % 2 == 0)).alias("dead"), (F.unix_timestamp("ts") % 86400).cast("double").alias("elapsed"), (run % 5 == 4).alias("cancel"),
    )


_VISITS = """SELECT epoch(date_trunc('day', ts))::BIGINT // 86400 AS run, event_id AS seq, user_id, event_type AS t, event_id % 10 = 0 AS seed, CASE event_type WHEN 'view' THEN 'fetched' WHEN 'click' THEN 'not_modified' WHEN 'purchase' THEN 'http_error' WHEN 'error' THEN 'network_error' ELSE 'skipped' END AS result,
 CASE WHEN event_type = 'view' THEN ['new', 'updated', 'unchanged', 'duplicate', 'near_duplicate'][event_id % 5 + 1] END AS article, floor(epoch(ts))::BIGINT % 86400 AS elapsed FROM events"""
_ANSWERED = "result IN ('fetched', 'not_modified', 'http_error')"


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each run."""
    out = crawl.crawl_stats(_visits(spark, sf_dir))
    return out.withColumns({"errors": F.array_join("errors", ";"), "hosts_unreachable": F.array_join("hosts_unreachable", ",")})


def run_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each run stopped, and after how many visits."""
    kept, why = crawl.stopped(_visits(spark, sf_dir), max_pages=150, pages_left=190, seconds=60_000)
    made = kept.groupBy("run").agg(F.count(F.lit(1)).alias("visits"))
    return why.join(made, "run", "left").select("run", "stopped_reason", F.coalesce("visits", F.lit(0)).alias("visits"))


def page_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table after two loads, the second on top of the first."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 304).when(F.col("event_type") == "purchase", 500)
    failed = F.when(F.col("event_type").isin("error", "purchase"), _say("e", _n("event_id")))
    rows = e.select((F.col("user_id") % 3).alias("workspace_id"), F.col("user_id").alias("url_hash"), F.col("event_id").alias("seq"), status.alias("status"), failed.alias("error"), F.when(F.col("event_id") % 3 != 0, _say("t", _n("event_id"))).alias("etag"))
    half = F.col("seq") % 2 == 0
    # numbers only order a load
    first = cut(stats.page_book(rows.filter(half)))
    return stats.page_book(rows.filter(~half), first).select(F.col("url_hash").alias("page"), "fetch_count", "failure_count", "last_error", "etag", "status")


def age_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are too old to be visited, by their date or that of the sitemap."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    published, lastmod = F.when(F.col("id") % 3 == 0, F.col("ts")), F.when(F.col("id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    old = lambda days: crawl.too_old(published, lastmod, datetime(1998, 1, 1), days)
    return o.select("id", old(1000).alias("too_old"), old(0).alias("without_limit"))


def sitemap_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sitemaps of an index are read: news first, then the newest."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = o.select(_say("https://s.example/", F.when(F.col("id") % 97 == 0, "News").otherwise("map"), _n("id")).alias("url"), F.when(F.col("id") % 11 != 0, F.col("ts")).alias("lastmod"))
    return crawl.sitemap_order(rows).select("url", F.date_format("lastmod", "yyyy-MM-dd").alias("day"))


def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sitemaps forty runs read, of trees in which each index names three others; every fifth map is also named by the first."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("run"), F.expr("o_orderkey div 40").alias("k"), F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    name = lambda k: F.concat(F.when(k % 7 == 3, F.lit("news")).otherwise(F.lit("map")), k.cast("string"))
    maps = o.select("run", "k", "id", name(F.col("k")).alias("map"), F.when(F.col("id") % 11 != 0, F.date_trunc("month", "ts")).alias("lastmod"))
    parents = F.array_compact(F.array(F.expr("(k - 1) div 3"), F.when(F.col("k") % 5 == 0, F.lit(0).cast("long"))))
    children = maps.filter("k > 0").select("run", "map", "lastmod", F.col("k").alias("pos"), F.explode(F.array_distinct(parents)).alias("parent")).withColumn("parent", name(F.col("parent")))
    walked = crawl.sitemap_walk(maps.filter("k = 0").select("run", "map", F.lit(0).alias("pos")), children, maps.select("run", "map", (F.col("id") % 13).alias("urls")), 30)
    return walked.select(F.col("run").cast("long").alias("run"), "map", "visit")


def newest_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest URLs of sitemaps, undated ones last."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = o.select(_say("u", _n("id")).alias("url"), F.when(F.col("id") % 2 == 0, F.col("ts")).alias("published_at"), F.when(F.col("id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("lastmod"))
    return crawl.newest(rows, 60).select("url")


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that servers ask to wait, as a number or as a date."""
    s = _suppliers(spark, sf_dir)
    k = F.col("id") % 5
    header = F.when(k == 0, _n(F.col("id") % 150)).when(k == 1, _say("Sat, 01 Jun 2024 00:01:", F.lpad(_n(F.col("id") % 60), 2, "0"), " GMT")).when(k == 2, "soon").when(k == 3, "Fri, 31 May 2024 23:00:00 GMT")
    return s.select("id", http.retry_after_seconds(header, F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("wait"))


# workspaces and listings


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array(*map(F.lit, (*stats.ROLES, "owner")))
    return _customers(spark, sf_dir).select("workspace_id", F.get(roles, (F.col("id") % 4).cast("int")).alias("role"), _say(_n(F.col("id") * 7919 % 10007), "@mail.example").alias("email"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "pending").otherwise("succeeded")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).cast("long").alias("workspace_id"), F.col("user_id").alias("source_id"), status.alias("status"))


def workspace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation as a workspace has."""
    spaces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return stats.workspace_counts(spaces, _suppliers(spark, sf_dir).withColumnRenamed("nation", "workspace_id"), _members(spark, sf_dir), _jobs(spark, sf_dir))


def member_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of one workspace in order, with their places, and what they may do."""
    one = stats.member_list(stats.visible(_members(spark, sf_dir), 7))
    # one workspace's members are few
    places = one.select((F.row_number().over(Window.orderBy(F.col("role").desc(), "email")) - 1).alias("place"), "role", "email")
    return places.withColumns({f"may_{r}": stats.may(F.col("role"), r) for r in stats.ROLES})


def jobs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred running jobs of one workspace."""
    return stats.job_list(stats.visible(_jobs(spark, sf_dir), 3), status="running").select("id", "source_id", "status")


def article_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of articles' sources, or of their sites where the source is unknown."""
    rows = _customers(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 40).alias("source_id"), F.when(F.col("id") % 7 != 0, _say("site ", _n("id"))).alias("site_name"))
    return stats.with_source_names(rows, _suppliers(spark, sf_dir).filter("id % 2 = 0")).select("id", "source_name")


_URL = "'https://www.site' || (id % 9) || '.example/2024/05/a-story-of-' || id"
_SUPPLIERS = "(SELECT s_suppkey::BIGINT AS id, s_name AS name, s_nationkey::BIGINT AS nation FROM supplier)"
_ORDERS = "(SELECT o_orderkey::BIGINT AS id, o_orderdate::TIMESTAMP AS ts FROM orders)"
_MEMBERS = "(SELECT c_nationkey::BIGINT AS workspace_id, ['viewer', 'editor', 'admin', 'owner'][(c_custkey % 4 + 1)::INTEGER] AS role, (c_custkey::BIGINT * 7919 % 10007) || '@mail.example' AS email FROM customer)"
_STATUS = "CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'pending' ELSE 'succeeded' END"
_BODY = "id % 7 * 30"

QUERIES = {
    "clean_texts": (clean_texts, f"SELECT id, name || ' & more! ' || chr(10) || chr(10) || chr(10) || chr(10) || ' x < y' AS as_text, '<b>' || name || '</b> & more!' || chr(10) || chr(10) || 'x < y' AS as_body FROM {_SUPPLIERS}"),
    "author_lists": (author_lists, f"SELECT id, 'Ann ' || name || '|Bo Li|Eva|Jon|' || name AS authors FROM {_SUPPLIERS}"),
    "site_titles": (
        site_titles,
        f"""SELECT id, CASE id % 4 WHEN 2 THEN name WHEN 3 THEN 'Story about ' || name || ' now' ELSE 'Story' END AS title, 'a b ' || id AS workspace, CASE WHEN id % 4 = 3 THEN id::VARCHAR ELSE 'first last ' || id END || '''s workspace' AS personal,
 CASE WHEN id % 4 = 1 THEN NOT contains(name, ' ') ELSE true END AS is_email FROM {_SUPPLIERS}""",
    ),
    "shown_times": (
        shown_times,
        f"""SELECT id, CASE WHEN a < 60 THEN 'now' WHEN a >= 2592000 THEN strftime(TIMESTAMP '2024-06-01' - to_seconds(s), '%Y-%m-%d') WHEN s >= 0 THEN x || ' ago' ELSE 'in ' || x END AS shown, (id % 101) || '%' AS share,
 CASE WHEN d < 60 THEN d || 's' WHEN d < 3600 THEN (d // 60) || 'm ' || (d % 60) || 's' ELSE (d // 3600) || 'h ' || (d // 60 % 60) || 'm' END AS took FROM
 (SELECT *, abs(s) AS a, CASE WHEN abs(s) < 3600 THEN (abs(s) // 60) || 'm' WHEN abs(s) < 86400 THEN (abs(s) // 3600) || 'h' ELSE (abs(s) // 86400) || 'd' END AS x FROM (SELECT id, id * 977 % 4000000 - 200000 AS s, id % 9000 AS d FROM {_ORDERS}))""",
    ),
    "public_ips": (public_ips, "SELECT c_custkey::BIGINT AS id, CASE c_custkey % 10 WHEN 9 THEN NULL ELSE c_custkey % 10 IN (0, 4, 6, 7) END AS public FROM customer"),
    "linked_articles": (
        linked_articles,
        f"""SELECT id AS page_id, 'Story & more ' || id AS title, 'Ann A' || id || '|Bo Li' AS authors, '2024-05-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') || ' 10:00' AS published, 'k' || (id % 5) || '|common' AS tags, 'S' || (id % 3) AS category, '/i/' || id || '.png' AS image_url,
 'The Site' AS site_name, 'en' AS language, ({_BODY})::INTEGER AS word_count, {_BODY} >= 30 AS is_article, CASE WHEN id % 7 = 0 THEN 'jsonld' ELSE 'blocks' END AS primary_method, false AS used_fallback FROM {_SUPPLIERS}""",
    ),
    "meta_articles": (
        meta_articles,
        f"""SELECT id AS page_id, CASE WHEN id % 3 = 0 THEN 'Heading ' || id ELSE 'Story ' || id END AS title, 'Ann A' || id || '|Bo Li' AS authors, 't' || (id % 4) || '|u' AS tags, 'a b' AS description,
 CASE WHEN id % 3 = 1 THEN 'https://www.site' || (id % 9) || '.example/c/' || id ELSE {_URL} END AS canonical_url, CASE WHEN id % 3 = 2 THEN 'https://other.test/x' END AS external_canonical, id % 5 = 0 AS noindex, false AS nofollow,
 id % 5 <> 0 AND id % 7 * 40 >= 30 AND s >= 0.5 AS is_article, 'metatags' AS title_from
 FROM (SELECT *, round(0.05 + CASE WHEN w >= 120 THEN 0.25 WHEN w >= 60 THEN 0.05 ELSE -0.2 END + CASE WHEN w >= 300 THEN 0.1 ELSE 0 END + CASE WHEN w >= 120 THEN 0.1 ELSE 0 END + 0.1, 3) AS s FROM (SELECT *, id % 7 * 40 AS w FROM {_SUPPLIERS}))""",
    ),
    "page_directives": (
        page_directives,
        f"""SELECT id AS page_id, 'https://www.site' || (id % 9) || '.example/b/p' || id || ' https://www.site' || (id % 9) || '.example/q https://o' || id || '.example/' AS links,
 'https://www.site' || (id % 9) || '.example/feed' || id || '.xml' AS feeds, 'noarchive,none' AS directives FROM {_SUPPLIERS}""",
    ),
    "page_articles": (page_articles, "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)', 1) AS language, 0 AS authors, true AS undated, false AS noindex, false AS used_fallback FROM pages"),
    "page_traces": (page_traces, "SELECT page_id, true AS clipped, 64 AS hash_chars, true AS few_links, 0 AS feeds FROM pages"),
    "run_counters": (
        run_counters,
        f"""SELECT run, count(*) FILTER ({_ANSWERED} AND NOT seed) AS pages_fetched, count(*) FILTER ({_ANSWERED} AND seed) AS seed_fetches, count(*) FILTER (result <> 'skipped') AS fetches, sum(seq % 3)::BIGINT AS llm_calls, count(*) FILTER (result IN ('http_error', 'network_error')) AS pages_failed,
 count(*) FILTER (result = 'skipped') AS pages_skipped, count(*) FILTER (result = 'not_modified') AS not_modified, 0::BIGINT AS robots_blocked, count(*) FILTER (seq % 4 = 0) AS rendered, count(article) AS articles_found, count(*) FILTER (article = 'new') AS articles_new,
 count(*) FILTER (article = 'updated') AS articles_updated, count(*) FILTER (article IN ('duplicate', 'near_duplicate')) AS duplicates, 2 * count(*) AS discovered,
 coalesce(array_to_string(list_sort(list_distinct(list('h' || (user_id % 7)) FILTER (result = 'skipped' AND user_id % 2 = 0))), ','), '') AS hosts_unreachable,
 coalesce(array_to_string(list_reverse(list_slice(list('u' || seq || ': ' || t ORDER BY seq DESC) FILTER (result IN ('http_error', 'network_error')), 1, 20)), ';'), '') AS errors FROM ({_VISITS}) GROUP BY run""",
    ),
    "run_stops": (
        run_stops,
        f"""WITH v AS ({_VISITS}), s AS (SELECT run, seq, elapsed, coalesce(sum(CASE WHEN {_ANSWERED} AND NOT seed THEN 1 ELSE 0 END) OVER b, 0) AS p, coalesce(sum(CASE WHEN result <> 'skipped' THEN 1 ELSE 0 END) OVER b, 0) AS f, row_number() OVER (PARTITION BY run ORDER BY seq) - 1 AS n FROM v
 WINDOW b AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN p >= 150 THEN 'max_pages' WHEN f >= 190 THEN 'daily_quota' WHEN elapsed > 60000 THEN 'time_budget' WHEN n > 0 AND n % 20 = 0 AND run % 5 = 4 THEN 'cancelled' END AS why FROM s), e AS (SELECT run, min(seq) AS seq, arg_min(why, seq) AS why FROM t WHERE why IS NOT NULL GROUP BY run)
SELECT t.run, coalesce(any_value(e.why), 'frontier_exhausted') AS stopped_reason, count(*) FILTER (e.seq IS NULL OR t.seq < e.seq) AS visits FROM t LEFT JOIN e USING (run) GROUP BY t.run""",
    ),
    "page_updates": (
        page_updates,
        """WITH v AS (SELECT *, row_number() OVER (ORDER BY event_id % 2, event_id) AS o FROM events), k AS (SELECT user_id, count(*) AS n, max(o) FILTER (event_type = 'view') AS ok, max(o) FILTER (event_type IN ('view', 'purchase')) AS tag, max(o) FILTER (event_type IN ('view', 'click', 'purchase')) AS seen FROM v GROUP BY 1),
f AS (SELECT user_id, count(*) AS n, max(o) AS last FROM v JOIN k USING (user_id) WHERE event_type IN ('error', 'purchase') AND (ok IS NULL OR o > ok) GROUP BY 1)
SELECT k.user_id AS page, k.n AS fetch_count, coalesce(f.n, 0) AS failure_count, (SELECT 'e' || event_id FROM v WHERE o = f.last) AS last_error, (SELECT CASE WHEN event_id % 3 <> 0 THEN 't' || event_id END FROM v WHERE o = k.tag) AS etag,
 (SELECT CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 304 ELSE 500 END FROM v WHERE o = k.seen) AS status FROM k LEFT JOIN f USING (user_id)""",
    ),
    "age_gate": (
        age_gate,
        f"SELECT id, coalesce(coalesce(CASE WHEN id % 3 = 0 THEN ts END, CASE WHEN id % 5 <> 0 THEN ts + INTERVAL 400 DAY END) < TIMESTAMP '1998-01-01' - INTERVAL 1000 DAY, false) AS too_old, false AS without_limit FROM {_ORDERS}",
    ),
    "sitemap_children": (
        sitemap_children,
        f"SELECT url, strftime(m, '%Y-%m-%d') AS day FROM (SELECT 'https://s.example/' || CASE WHEN id % 97 = 0 THEN 'News' ELSE 'map' END || id AS url, CASE WHEN id % 11 <> 0 THEN ts END AS m FROM {_ORDERS}) ORDER BY CASE WHEN contains(url, 'News') THEN 0 ELSE 1 END, m DESC NULLS LAST, url LIMIT 25",
    ),
    "sitemap_walk": (
        sitemap_walk,
        """WITH RECURSIVE m AS (SELECT o_orderkey % 40 AS run, o_orderkey // 40 AS k, CASE WHEN (o_orderkey // 40) % 7 = 3 THEN 'news' ELSE 'map' END || (o_orderkey // 40) AS map, o_orderkey % 13 AS urls,
 CASE WHEN o_orderkey % 11 <> 0 THEN date_trunc('month', o_orderdate::TIMESTAMP) END AS lastmod FROM orders),
e AS (SELECT run, k, parent, row_number() OVER (PARTITION BY run, parent ORDER BY CASE WHEN contains(map, 'news') THEN 0 ELSE 1 END, lastmod DESC NULLS LAST, k) AS rank FROM
 (SELECT m.*, (k - 1) // 3 AS parent FROM m WHERE k > 0 UNION ALL SELECT m.*, 0 AS parent FROM m WHERE k > 3 AND k % 5 = 0)),
w AS (SELECT run, k, [0::BIGINT] AS path FROM m WHERE k = 0 UNION ALL SELECT e.run, e.k, list_append(w.path, e.rank) FROM w JOIN e ON e.run = w.run AND e.parent = w.k),
f AS (SELECT run, k, min(path) AS path FROM w GROUP BY run, k),
v AS (SELECT run, map, row_number() OVER o AS visit, coalesce(sum(urls) OVER (PARTITION BY run ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f JOIN m USING (run, k) WINDOW o AS (PARTITION BY run ORDER BY path))
SELECT CAST(run AS BIGINT) AS run, map, visit FROM v WHERE visit <= 25 AND before < 100""",
    ),
    "newest_urls": (newest_urls, f"SELECT 'u' || id AS url FROM {_ORDERS} ORDER BY CASE WHEN id % 2 = 0 THEN ts WHEN id % 3 = 0 THEN ts + INTERVAL 30 DAY ELSE TIMESTAMP '1970-01-01' END DESC, 'u' || id LIMIT 180"),
    "waits": (waits, f"SELECT id, CASE id % 5 WHEN 0 THEN CASE WHEN id % 150 <= 120 THEN (id % 150)::DOUBLE END WHEN 1 THEN (60 + id % 60)::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS wait FROM {_SUPPLIERS}"),
    "workspace_totals": (
        workspace_totals,
        f"""SELECT n_nationkey::BIGINT AS id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS sources, (SELECT count(*) FROM {_MEMBERS} WHERE workspace_id = n_nationkey) AS members, (SELECT count(*) FROM {_MEMBERS} WHERE workspace_id = n_nationkey AND role = 'admin') AS admins,
 (SELECT count(*) FROM events WHERE user_id % 25 = n_nationkey AND {_STATUS} <> 'succeeded') AS active_crawls FROM nation""",
    ),
    "member_order": (
        member_order,
        f"SELECT (row_number() OVER (ORDER BY role DESC, email) - 1)::INTEGER AS place, role, email, role IN ('viewer', 'editor', 'admin') AS may_viewer, role IN ('editor', 'admin') AS may_editor, role = 'admin' AS may_admin FROM {_MEMBERS} WHERE workspace_id = 7",
    ),
    "jobs_filtered": (jobs_filtered, f"SELECT event_id AS id, user_id AS source_id, 'running' AS status FROM events WHERE user_id % 25 = 3 AND {_STATUS} = 'running' ORDER BY event_id DESC LIMIT 100"),
    "article_sources": (
        article_sources,
        f"SELECT c_custkey::BIGINT AS id, coalesce(s.name, CASE WHEN c_custkey % 7 <> 0 THEN 'site ' || c_custkey END) AS source_name FROM customer LEFT JOIN {_SUPPLIERS} s ON c_custkey % 3 <> 0 AND s.id = c_custkey % 40 AND s.id % 2 = 0",
    ),
}
