"""The frontier and a simulated crawl over tables of pages and links."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import article_url_score
from newsloom.session import cut

BOOST = {"feed": 1.0, "sitemap": 0.8, "inline-feed": 0.5, "inline-sitemap": 0.3, "link": 0.0}
MAX_SEEN = 5000


def priority(url: Column, via: Column, published: Column, as_of: datetime) -> Column:
    """Boost of where a URL was found, recency over 30 days, and how much it looks like an article's; seeds have 0.5."""
    boost = F.lit(0.0)
    for name, b in BOOST.items():
        boost = F.when(via == name, F.lit(b)).otherwise(boost)
    age = (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(published)) / F.lit(86400.0)
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - age / 30) * 0.5, F.lit(0.0))
    return F.when(via == "seed", F.lit(0.5)).otherwise(boost + recency + article_url_score(url))


def too_old(published: Column, lastmod: Column, as_of: datetime, max_age_days: int) -> Column:
    """The page's date lies further back than allowed; without a date, or with no limit, it doesn't."""
    date = F.coalesce(published, lastmod)
    return F.coalesce(date < F.lit(as_of) - F.expr(f"INTERVAL {int(max_age_days)} DAYS"), F.lit(False)) if max_age_days > 0 else F.lit(False)


def frontier(found: DataFrame, cap: int = MAX_SEEN) -> DataFrame:
    """found (url, seq, prio) in order of visit: each URL once, at its first place, and only the first ``cap`` ever seen."""
    once = found.groupBy("url").agg(F.min_by("prio", "seq").alias("prio"), F.min("seq").alias("seq"))
    return once.orderBy("seq").limit(cap).orderBy(F.col("prio").desc(), "seq")


def sitemap_order(children: DataFrame, limit: int = 25) -> DataFrame:
    """Child sitemaps to read: news first, then newest, undated last."""
    news = F.contains(F.lower("url"), F.lit("news"))
    return children.orderBy((~news).cast("int"), F.col("lastmod").desc_nulls_last(), "url").limit(limit)


def sitemap_walk(roots: DataFrame, children: DataFrame, sizes: DataFrame, max_pages: int, limit: int = 25) -> DataFrame:
    """(run, map, visit) of the sitemaps that each run reads, in order.

    roots (run, map, pos) are the maps a run begins with, children (run, parent, map, lastmod, pos) those that an index names (only the
    ones that are wanted), sizes (run, map, urls) how many URLs a map gives. The walk is depth-first: after an index come
    its children, news first, then the newest, undated last, in the index's order where these are equal; a map is read at its
    first place only. A run ends after ``limit`` maps, or before the next one once it has three times max_pages URLs, 100 at least.

    A map's place is the path of ranks that leads to it; paths in order are the walk. Each step adds the children of the maps
    that the last one placed, and keeps ``limit`` places of a run, so a run's tables stay that small however large its sitemaps are.
    """
    news = F.contains(F.lower("map"), F.lit("news"))
    order = Window.partitionBy("run", "parent").orderBy((~news).cast("int"), F.col("lastmod").desc_nulls_last(), "pos")
    # of equal names under one index the first counts, and no run reads more than the limit of one index's
    once = children.groupBy("run", "parent", "map").agg(F.min(F.struct("pos", "lastmod")).alias("x")).select("run", "parent", "map", "x.*")
    ranked = cut(once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("run", "parent", "map", "rank"))
    first = Window.partitionBy("run").orderBy("path")

    def places(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("run", "map").agg(F.min("path").alias("path"))
        return cut(best.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit).drop("_n"))

    placed = places(roots.select("run", "map", F.array(F.col("pos").cast("int")).alias("path")))
    fresh = placed
    while not fresh.isEmpty():
        found = fresh.withColumnRenamed("map", "parent").join(ranked, ["run", "parent"]).select("run", "map", F.array_append("path", F.col("rank").cast("int")).alias("path"))
        after = places(placed.unionByName(found))
        fresh = after.join(placed, ["run", "map", "path"], "left_anti")
        placed = after
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.coalesce("urls", F.lit(0))).over(before), F.lit(0))
    walked = placed.join(sizes.select("run", "map", "urls"), ["run", "map"], "left").withColumn("visit", F.row_number().over(first)).withColumn("_seen", seen)
    return walked.filter(F.col("_seen") < max(3 * max_pages, 100)).select("run", "map", F.col("visit").cast("long").alias("visit"))


def newest(urls: DataFrame, max_pages: int) -> DataFrame:
    """The newest URLs of sitemaps, three times as many as pages may be fetched, 100 at least."""
    date = F.coalesce("published_at", "lastmod", F.lit("1970-01-01").cast("timestamp"))
    return urls.orderBy(date.desc(), "url").limit(max(3 * max_pages, 100))


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int, max_pages: int, keep: Column | None = None) -> DataFrame:
    """(url, depth, visit) of a crawl of links (url, target) from seeds (url), level by level; keep says which targets count.

    Each level is one join of the last level with the links and one anti-join with all seen; levels are cut in the shared
    folder. Within a level URLs are visited by how much they look like articles, then by name; max_pages in all.
    """
    level = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, max_depth + 1):
        targets = links.join(level.select("url"), "url").select(F.col("target").alias("url")).distinct()
        if keep is not None:
            targets = targets.filter(keep)
        level = cut(targets.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    ranked = seen.withColumn("score", article_url_score(F.col("url"))).orderBy("depth", F.col("score").desc(), "url").limit(max_pages)
    # at most max_pages rows are left to number
    return ranked.withColumn("visit", F.row_number().over(Window.orderBy("depth", F.col("score").desc(), "url"))).drop("score")


#: What a visit came to: the fetch went through, changed nothing, was refused by the server or failed on the way; or it wasn't made.
FETCHED, NOT_MODIFIED, HTTP_ERROR, NETWORK_ERROR, ROBOTS, SKIPPED = "fetched", "not_modified", "http_error", "network_error", "robots", "skipped"
ANSWERED = (FETCHED, NOT_MODIFIED, HTTP_ERROR)
STOPS = ("max_pages", "daily_quota", "time_budget", "cancelled")
CHECK_EVERY, LAST_ERRORS = 20, 20


def crawl_stats(visits: DataFrame) -> DataFrame:
    """The counters of each run over its visits (run, seq, host, seed, result, article, error, rendered, llm_calls, discovered): article
    is what an article came to in the store, error a message. Errors are the last 20; hosts_unreachable are those whose visits
    were skipped after failures (column dead)."""
    is_ = lambda *kinds: F.coalesce(F.col("result").isin(*kinds), F.lit(False))
    count = lambda test, name: F.count_if(test).alias(name)
    kind = lambda *names: F.coalesce(F.col("article").isin(*names), F.lit(False))
    latest = F.row_number().over(Window.partitionBy("run").orderBy(F.col("seq").desc()))
    last = visits.filter("error is not null").withColumn("_n", latest).filter(F.col("_n") <= LAST_ERRORS)
    errors = last.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "url", "error").alias("text")))).alias("_errors"))
    counted = visits.groupBy("run").agg(
        count(is_(*ANSWERED) & ~F.col("seed"), "pages_fetched"), count(is_(*ANSWERED) & F.col("seed"), "seed_fetches"), count(is_(*ANSWERED, NETWORK_ERROR), "fetches"),
        F.coalesce(F.sum("llm_calls"), F.lit(0)).alias("llm_calls"), count(is_(HTTP_ERROR, NETWORK_ERROR), "pages_failed"), count(is_(SKIPPED), "pages_skipped"),
        count(is_(NOT_MODIFIED), "not_modified"), count(is_(ROBOTS), "robots_blocked"), count(F.coalesce(F.col("rendered"), F.lit(False)), "rendered"),
        count(F.col("article").isNotNull(), "articles_found"), count(kind("new"), "articles_new"), count(kind("updated"), "articles_updated"),
        count(kind("duplicate", "near_duplicate"), "duplicates"), F.coalesce(F.sum("discovered"), F.lit(0)).alias("discovered"),
        F.array_sort(F.collect_set(F.when(F.col("dead"), F.col("host")))).alias("hosts_unreachable"),
    )
    told = F.coalesce(F.transform("_errors", lambda e: e["text"]), F.array().cast("array<string>"))
    return counted.join(errors, "run", "left").withColumn("errors", told).drop("_errors")


def stopped(visits: DataFrame, max_pages: int, pages_left: int | None = None, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(visits that a run makes, (run, stopped_reason)) of runs over their possible visits (run, seq, seed, result, elapsed, cancel) in
    order of seq.

    Before each visit a run stops if it has fetched its pages, its workspace's quota is used up, its time has passed (elapsed,
    in seconds, when the visit would begin), or, after every 20th visit, it has been cancelled. A run without any of these ends
    when the frontier is empty.
    """
    before = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda test: F.coalesce(F.sum(test.cast("int")).over(before), F.lit(0))
    answered = F.coalesce(F.col("result").isin(*ANSWERED), F.lit(False))
    made = F.coalesce(F.count(F.lit(1)).over(before), F.lit(0))
    cancelled = (made > 0) & (made % CHECK_EVERY == 0) & F.coalesce(F.lag("cancel").over(Window.partitionBy("run").orderBy("seq")), F.lit(False))
    network = answered | F.coalesce(F.col("result") == NETWORK_ERROR, F.lit(False))
    tests = (
        so_far(answered & ~F.col("seed")) >= max_pages,
        so_far(network) >= pages_left if pages_left is not None else F.lit(False),
        F.col("elapsed") > seconds if seconds is not None else F.lit(False),
        cancelled,
    )
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(STOPS, tests, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    marked = visits.withColumn("_stop", reason)
    first = marked.filter("_stop is not null").groupBy("run").agg(F.min(F.struct("seq", "_stop")).alias("first"))
    ends = visits.select("run").distinct().join(first, "run", "left")
    kept = visits.join(ends, "run").filter("first is null or seq < first.seq").drop("first")
    return kept, ends.select("run", F.coalesce("first._stop", F.lit("frontier_exhausted")).alias("stopped_reason"))
