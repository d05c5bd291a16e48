from datetime import date, datetime

from newsloom.operators import crawl, stats

NOW = datetime(2024, 5, 10, 12)


def test_per_day_and_languages(spark):
    rows = spark.createDataFrame([(datetime(2024, 5, 10, 1), "en"), (datetime(2024, 5, 8, 23, 59), ""), (datetime(2024, 5, 1), None), (datetime(2024, 5, 9), "de"), (datetime(2024, 5, 9), "en")], "ts timestamp, language string")
    got = {r.date: r["count"] for r in stats.per_day(rows, "ts", NOW, 3).collect()}
    assert got == {date(2024, 5, 8): 1, date(2024, 5, 9): 2, date(2024, 5, 10): 1}
    assert [(r.language, r["count"]) for r in stats.top_languages(rows, 2).collect()] == [("en", 2), ("unknown", 2)]


def jobs(spark, rows):
    return spark.createDataFrame(rows, "id long, source_id long, workspace_id long, status string, created_at timestamp, fetched int, error string")


def test_jobs(spark):
    j = jobs(spark, [(1, 1, 1, "failed", NOW, 5, None), (2, 1, 1, "succeeded", datetime(2024, 5, 9, 12), None, None), (3, 2, 1, "running", datetime(2024, 5, 9, 11, 59), 7, None), (4, 2, 1, "pending", datetime(2024, 5, 10, 11), 3, None)])
    assert stats.last_24h(j, NOW, ["fetched"]).first().fetched == 8
    assert {r.source_id: r.status for r in stats.latest_status(j).collect()} == {1: "succeeded", 2: "pending"}
    assert {r.source_id: r.status for r in stats.latest_status(j, 1).collect()} == {2: "pending"}
    assert {r.id: (r.status, r.error) for r in stats.reap(j, NOW).collect()}[3] == ("failed", "stale job reaped")
    sources = spark.createDataFrame([(1, True), (9, False)], "id long, enabled boolean")
    arts = spark.createDataFrame([(1,), (1,)], "source_id long")
    assert {r.id: (r.articles, r.last_status) for r in stats.source_overview(sources, arts, j).collect()} == {1: (2, "succeeded"), 9: (0, None)}
    t = stats.source_totals(sources, j).first()
    assert (t.sources, t.sources_enabled, t.jobs_active) == (2, 1, 2)


def test_quotas(spark):
    day = date(2024, 5, 10)
    usage = spark.createDataFrame([(1, day, 10, 1, 1)], "workspace_id long, day date, pages int, llm_calls int, crawls int")
    more = spark.createDataFrame([(1, day, 5, None, 0), (2, day, 0, 0, 0), (3, day, 600, 0, 1)], "workspace_id long, day date, pages int, llm_calls int, crawls int")
    out = stats.add_usage(usage, more)
    assert {r.workspace_id: (r.pages, r.llm_calls) for r in out.collect()} == {1: (15, 1), 3: (600, 0)}
    spaces = spark.createDataFrame([(1, 20), (2, None), (3, None)], "id long, max_pages_per_day int")
    from pyspark.sql import functions as F

    assert {r.id: (r.used, r.left) for r in stats.pages_left(spaces, out, F.lit(day)).collect()} == {1: (15, 5), 2: (0, 500), 3: (600, 0)}
    share, level = stats.usage_meter(F.col("u"), F.col("l"))
    df = spark.createDataFrame([(0, 0), (8, 10), (7, 10), (12, 10)], "u int, l int")
    assert [tuple(r) for r in df.select(share, level).collect()] == [(1.0, "full"), (0.8, "high"), (0.7, "ok"), (1.0, "full")]


def test_dispatch(spark):
    late, soon = datetime(2024, 5, 10), datetime(2024, 5, 11)
    sources = spark.createDataFrame([(1, 1, True, None), (2, 1, True, late), (3, 1, True, late), (4, 1, True, soon), (5, 2, True, None), (6, 1, False, None), (7, 3, True, late)], "id long, workspace_id long, enabled boolean, next_crawl_at timestamp")
    j = jobs(spark, [(1, 2, 1, "running", NOW, 0, None)])
    spaces = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "id long, max_concurrent_crawls int")
    usage = spark.createDataFrame([(3, NOW.date(), 500)], "workspace_id long, day date, pages int")
    assert {r.source_id for r in stats.dispatch(sources, j, spaces, usage, NOW).collect()} == {1, 5}
    assert [r.id for r in stats.due_sources(sources, NOW).collect()] == [1, 5, 2, 3, 7]


def test_page_book(spark):
    rows = [(1, "a", 1, 200, None, "x"), (1, "a", 2, 500, "e1", None), (1, "a", 3, 304, None, "y"), (1, "a", 4, None, "e2", None), (1, "b", 1, None, "e0", None), (1, "b", 2, 200, None, "z")]
    df = spark.createDataFrame(rows, "workspace_id long, url_hash string, seq long, status int, error string, etag string")
    got = {r.url_hash: (r.fetch_count, r.failure_count, r.last_error, r.etag) for r in stats.page_book(df).collect()}
    # the answer with status 500 had no etag
    assert got == {"a": (4, 2, "e2", None), "b": (2, 0, None, "z")}


def test_breaker(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("h", i, f) for i, f in enumerate([True, True, True, False, True])], "host string, seq int, bad boolean")
    got = [(r.streak, r.open) for r in stats.breaker(df, "host", ["seq"], F.col("bad"), 2).orderBy("seq").collect()]
    assert got == [(1, False), (2, False), (3, True), (0, True), (1, False)]


def test_refetch_and_histogram(spark):
    pages = spark.createDataFrame([(1, "old", True, datetime(2024, 5, 1)), (1, "new", True, NOW), (1, "no", False, NOW)], "workspace_id long, url_hash string, is_article boolean, last_fetched_at timestamp")
    found = spark.createDataFrame([(1, h, v) for h, v in [("old", "feed"), ("new", "feed"), ("no", "sitemap"), ("unknown", "feed"), ("new", "link")]], "workspace_id long, url_hash string, via string")
    got = {(r.url_hash, r.via): r.fetch for r in stats.refetch(found, pages, NOW).collect()}
    assert got == {("old", "feed"): True, ("new", "feed"): False, ("no", "sitemap"): True, ("unknown", "feed"): True, ("new", "link"): True}
    values = spark.createDataFrame([(0.05,), (0.5,), (99.0,), (None,)], "v double")
    assert [r["count"] for r in stats.histogram(values, "v", (0.1, 1.0)).collect()] == [1, 2, 3]


def test_frontier(spark):
    found = spark.createDataFrame([("a", 1, 0.2), ("b", 2, 0.9), ("a", 3, 5.0), ("c", 4, 0.9), ("d", 5, 9.0)], "url string, seq long, prio double")
    assert [r.url for r in crawl.frontier(found, 3).collect()] == ["b", "c", "a"]


def test_crawl(spark):
    links = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("c", "s"), ("c", "d"), ("b", "x")], "url string, target string")
    from pyspark.sql import functions as F

    seeds = spark.createDataFrame([("s",)], "url string")
    got = {r.url: r.depth for r in crawl.crawl(seeds, links, 2, 99, F.col("url") != "x").collect()}
    assert got == {"s": 0, "a": 1, "b": 1, "c": 2}
    assert crawl.crawl(seeds, links, 0, 99).count() == 1 and crawl.crawl(seeds, links, 9, 3).count() == 3


def test_orders_and_stats(spark):
    kids = spark.createDataFrame([("s", datetime(2024, 5, 1), None), ("news", datetime(2024, 1, 1), None), ("t", None, None), ("u", datetime(2024, 5, 9), None)], "url string, lastmod timestamp, published_at timestamp")
    assert [r.url for r in crawl.sitemap_order(kids, 3).collect()] == ["news", "u", "s"]
    assert [r.url for r in crawl.newest(kids, 1).collect()] == ["u", "s", "news", "t"]
    from pyspark.sql import functions as F

    assert [r[0] for r in kids.select(crawl.too_old(F.col("published_at"), F.col("lastmod"), NOW, 30)).collect()] == [False, True, False, False]


VISIT = "run long, seq int, url string, host string, seed boolean, result string, article string, error string, rendered boolean, llm_calls int, discovered int, dead boolean, elapsed double, cancel boolean"


def visit(run, seq, result="fetched", host="h", **kw):
    return (run, seq, f"u{seq}", host, kw.get("seed", False), result, kw.get("article"), kw.get("error"), kw.get("rendered"), kw.get("llm_calls"), kw.get("discovered", 1), kw.get("dead", False), kw.get("elapsed", float(seq)), kw.get("cancel", False))


def test_run_counters(spark):
    rows = [visit(1, 0, seed=True), visit(1, 1, article="new", rendered=True, llm_calls=2), visit(1, 2, "not_modified"), visit(1, 3, "http_error", error="HTTP 500"), visit(1, 4, "network_error", "g", error="lost")]
    rows += [visit(1, 5, "skipped", "g", dead=True), visit(1, 6, "robots"), visit(1, 7, article="near_duplicate"), visit(1, 8, article="unchanged"), visit(1, 9, article="updated"), visit(1, 10, article="duplicate")]
    rows += [visit(2, i, "network_error", error=f"e{i}") for i in range(30)]
    got = {r.run: r.asDict() for r in crawl.crawl_stats(spark.createDataFrame(rows, VISIT)).collect()}
    want = {"pages_fetched": 7, "seed_fetches": 1, "fetches": 9, "llm_calls": 2, "pages_failed": 2, "pages_skipped": 1, "not_modified": 1, "robots_blocked": 1, "rendered": 1, "articles_found": 5, "articles_new": 1, "articles_updated": 1, "duplicates": 2, "discovered": 11, "hosts_unreachable": ["g"], "errors": ["u3: HTTP 500", "u4: lost"]}
    assert {k: got[1][k] for k in want} == want
    assert got[2]["errors"] == [f"u{i}: e{i}" for i in range(10, 30)] and got[2]["pages_failed"] == 30


def test_a_run_stops(spark):
    rows = [visit(1, i) for i in range(9)] + [visit(2, i, "network_error") for i in range(9)] + [visit(3, i, seed=True, elapsed=30.0 * i) for i in range(9)]
    rows += [visit(4, i, "skipped", cancel=i >= 25, elapsed=0.0) for i in range(70)] + [visit(5, i, "not_modified", elapsed=0.0) for i in range(3)]
    kept, why = crawl.stopped(spark.createDataFrame(rows, VISIT), 5, 7, 100.0)
    assert {r.run: r.stopped_reason for r in why.collect()} == {1: "max_pages", 2: "daily_quota", 3: "time_budget", 4: "cancelled", 5: "frontier_exhausted"}
    assert {r["run"]: r["count"] for r in kept.groupBy("run").count().collect()} == {1: 5, 2: 7, 3: 4, 4: 40, 5: 3}


def test_pages_on_top_of_stored_ones(spark):
    kind = "workspace_id long, url_hash string, seq int, status int, error string, etag string"
    first = [(1, "a", 1, 200, None, "x"), (1, "a", 2, None, "lost", None), (1, "b", 3, 500, "HTTP 500", None), (1, "c", 4, 304, None, None)]
    more = [(1, "a", 5, None, "lost again", None), (1, "b", 6, 200, None, None), (1, "d", 7, 200, None, "y"), (1, "c", 8, None, "z" * 2000, None)]
    df = lambda rows: spark.createDataFrame(rows, kind)
    step = stats.page_book(df(more), spark.createDataFrame(stats.page_book(df(first)).collect(), stats.page_book(df(first)).schema))
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(step) == key(stats.page_book(df(first + more)))
    got = {r.url_hash: (r.fetch_count, r.failure_count, r.last_error and len(r.last_error), r.etag, r.status) for r in step.collect()}
    assert got == {"a": (3, 2, 10, "x", 200), "b": (2, 0, None, None, 200), "c": (2, 1, 1000, None, 304), "d": (1, 0, None, "y", 200)}


def test_members_and_roles(spark):
    from pyspark.sql import functions as F

    members = spark.createDataFrame([(1, "viewer", "c@x"), (1, "admin", "b@x"), (2, "editor", "a@x"), (1, "viewer", "a@x")], "workspace_id long, role string, email string")
    assert [r.email for r in stats.member_list(stats.visible(members, 1)).collect()] == ["a@x", "c@x", "b@x"]
    roles = spark.createDataFrame([(x,) for x in ("viewer", "editor", "admin", "owner", None)], "role string")
    assert [tuple(r) for r in roles.select(*(stats.may(F.col("role"), x) for x in stats.ROLES)).collect()] == [(True, False, False), (True, True, False), (True, True, True)] + [(False,) * 3] * 2
    spaces = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    jobs = spark.createDataFrame([(1, 1, 7, "pending"), (2, 2, 7, "failed"), (3, 1, 8, "running")], "id long, workspace_id long, source_id long, status string")
    counts = {r.id: (r.sources, r.members, r.admins, r.active_crawls) for r in stats.workspace_counts(spaces, jobs, members, jobs).collect()}
    assert counts == {1: (2, 3, 1, 2), 2: (1, 1, 0, 0), 3: (0, 0, 0, 0)}
    assert [r.id for r in stats.job_list(jobs, source_id=7).collect()] == [2, 1] and [r.id for r in stats.job_list(jobs, status="running").collect()] == [3]
