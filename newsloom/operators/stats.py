"""Dashboard aggregates, quotas, scheduling and page bookkeeping. The time is always a parameter."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import plain_join

ACTIVE = ("pending", "running")
#: What a workspace may have if it says nothing else.
DEFAULT_LIMITS = {"max_sources": 10, "max_pages_per_day": 500, "max_pages_per_crawl": 200, "min_interval_minutes": 30, "max_concurrent_crawls": 2, "max_llm_per_day": 25, "max_members": 25}
LATENCY_EDGES = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
MAX_FAILURES = 5


def article_totals(articles: DataFrame) -> DataFrame:
    """Originals and duplicates in one pass."""
    dup = F.col("duplicate_of_id").isNotNull()
    return articles.agg(F.count_if(~dup).alias("articles"), F.count_if(dup).alias("duplicates"))


def source_totals(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    counts = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if("enabled").alias("sources_enabled"))
    return counts.crossJoin(jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("jobs_active")))  # one row each


def last_24h(jobs: DataFrame, as_of: datetime, counters: list[str]) -> DataFrame:
    """Sums of counters over jobs of the last day; missing ones count nothing."""
    recent = jobs.filter(F.col("created_at") >= F.lit(as_of - timedelta(hours=24)))
    return recent.agg(*(F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in counters))


def per_day(rows: DataFrame, ts: str, as_of: datetime, days: int) -> DataFrame:
    """(date, count) of the last ``days`` days, UTC, days without rows too."""
    if not 1 <= days <= 90:
        raise ValueError("days is 1 to 90")
    first = (as_of - timedelta(days=days - 1)).date()
    spine = rows.sparkSession.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    inside = rows.filter(F.col(ts) >= F.lit(datetime(first.year, first.month, first.day)))
    counts = inside.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("count"))


def top_languages(articles: DataFrame, k: int = 8, column: str = "language") -> DataFrame:
    """The k most frequent languages, those without one as unknown, ties by name."""
    name = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias("language")
    return articles.groupBy(name).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "language").limit(k)


def latest_status(jobs: DataFrame, newest: int = 500) -> DataFrame:
    """(source_id, status) of each source's last job among the newest ones."""
    return jobs.orderBy(F.col("id").desc()).limit(newest).groupBy("source_id").agg(F.max_by("status", "id").alias("status"))


def source_overview(sources: DataFrame, articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each source with its number of articles (0 if none) and last job's status (NULL if none)."""
    counts = articles.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("articles"))
    status = latest_status(jobs).select(F.col("source_id").alias("id"), F.col("status").alias("last_status"))
    return sources.join(counts, "id", "left").join(status, "id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))


def histogram(rows: DataFrame, value: str, edges: tuple[float, ...] = LATENCY_EDGES) -> DataFrame:
    """(le, count) of a cumulative histogram, the last without an upper edge (NULL), in one pass."""
    counts = rows.agg(*(F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(edges)), F.count(value).alias("_all"))
    pairs = [F.struct(F.lit(e).alias("le"), F.col(f"_{i}").alias("count")) for i, e in enumerate(edges)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("count"))]
    return counts.select(F.inline(F.array(*pairs)))


# quotas


def effective_limits(workspaces: DataFrame) -> DataFrame:
    """Workspaces with every limit, their own or the default."""
    return workspaces.select("id", *((F.coalesce(F.col(k), F.lit(v)) if k in workspaces.columns else F.lit(v)).alias(k) for k, v in DEFAULT_LIMITS.items()))


def add_usage(usage: DataFrame, deltas: DataFrame) -> DataFrame:
    """usage (workspace_id, day, pages, llm_calls, crawls) with deltas added; deltas of nothing make no row."""
    some = deltas.filter("coalesce(pages, 0) != 0 or coalesce(llm_calls, 0) != 0 or coalesce(crawls, 0) != 0")
    columns = ["workspace_id", "day", "pages", "llm_calls", "crawls"]
    both = usage.select(*columns).unionByName(some.select(*columns))
    return both.groupBy("workspace_id", "day").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns[2:]))


def pages_left(workspaces: DataFrame, usage: DataFrame, day: Column) -> DataFrame:
    """(id, used, left) of each workspace's pages on a day, never below 0."""
    today = usage.filter(F.col("day") == day).select(F.col("workspace_id").alias("id"), F.col("pages").alias("used"))
    joined = effective_limits(workspaces).join(today, "id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return joined.select("id", "used", F.greatest(F.lit(0), F.col("max_pages_per_day") - F.col("used")).alias("left"))


def usage_meter(used: Column, limit: Column) -> tuple[Column, Column]:
    """(share, level): a limit of 0 is full; level is full from 1, high from 0.8, else ok."""
    share = F.when(limit == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), used / limit))
    return share, F.when(share >= 1, "full").when(share >= 0.8, "high").otherwise("ok")


def workspace_counts(workspaces: DataFrame, sources: DataFrame, members: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, sources, members, admins, active_crawls) of each workspace, 0 where there is nothing; the other tables have workspace_id."""
    one = F.count(F.lit(1))
    per = lambda rows, *aggs: rows.groupBy(F.col("workspace_id").alias("id")).agg(*aggs)
    parts = [
        per(sources, one.alias("sources")),
        per(members, one.alias("members"), F.count_if(F.col("role") == "admin").alias("admins")),
        per(jobs.filter(F.col("status").isin(*ACTIVE)), one.alias("active_crawls")),
    ]
    out = workspaces.select("id")
    for part in parts:
        out = out.join(part, "id", "left")
    return out.fillna(0, ["sources", "members", "admins", "active_crawls"])


#: Roles, the least first.
ROLES = ("viewer", "editor", "admin")


def visible(rows: DataFrame, workspace_id: int) -> DataFrame:
    """Rows of one workspace; every read of the store goes through this."""
    return rows.filter(F.col("workspace_id") == workspace_id)


def may(role: Column, least: str) -> Column:
    """Whether a role is at least the one that an action asks for; unknown roles may nothing."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role) >= ROLES.index(least) + 1, F.lit(False)) & role.isin(*ROLES)


def member_list(members: DataFrame) -> DataFrame:
    """Members by role, in the descending order of its name, then by address."""
    return members.orderBy(F.col("role").desc(), "email")


def job_list(jobs: DataFrame, source_id: int | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest jobs, of one source or status if asked for."""
    for column, value in (("source_id", source_id), ("status", status)):
        jobs = jobs if value is None else jobs.filter(F.col(column) == value)
    return jobs.orderBy(F.col("id").desc()).limit(limit)


def with_source_names(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """articles (source_id, site_name) with source_name: that of sources (id, name), else the site's."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"))
    return articles.join(names, "source_id", "left").withColumn("source_name", F.coalesce("_name", "site_name")).drop("_name")


# scheduling


def due_sources(sources: DataFrame, as_of: datetime, limit: int = 100) -> DataFrame:
    """Enabled sources whose next crawl has come or was never set, longest overdue first."""
    due = sources.filter(F.col("enabled") & (F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= F.lit(as_of))))
    return due.orderBy(F.col("next_crawl_at").asc_nulls_first(), "id").limit(limit)


def dispatch(sources: DataFrame, jobs: DataFrame, workspaces: DataFrame, usage: DataFrame, as_of: datetime, limit: int = 100) -> DataFrame:
    """(source_id, workspace_id) of the jobs that one scheduler tick makes: due sources without an active job, as many as the
    workspace's limit of concurrent crawls leaves, of workspaces that have pages left today."""
    active = jobs.filter(F.col("status").isin(*ACTIVE))
    running = active.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("active"))
    quota = effective_limits(workspaces).select(F.col("id").alias("workspace_id"), "max_concurrent_crawls")
    left = pages_left(workspaces, usage, F.lit(as_of.date())).select(F.col("id").alias("workspace_id"), "left")
    due = due_sources(sources, as_of, limit)
    idle = due.join(active.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("next_crawl_at").asc_nulls_first(), "id"))
    ranked = idle.join(quota, "workspace_id").join(running, "workspace_id", "left").join(left, "workspace_id").withColumn("turn", turn)
    fits = (F.col("turn") + F.coalesce("active", F.lit(0)) <= F.col("max_concurrent_crawls")) & (F.col("left") > 0)
    return ranked.filter(fits).select(F.col("id").alias("source_id"), "workspace_id")


def reap(jobs: DataFrame, as_of: datetime, budget_seconds: int = 1800) -> DataFrame:
    """Jobs with active ones older than twice the budget and 15 minutes failed."""
    stale = F.col("status").isin(*ACTIVE) & (F.col("created_at") < F.lit(as_of - timedelta(seconds=2 * budget_seconds + 900)))
    out = jobs.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    out = out.withColumn("status", F.when(F.col("_stale"), "failed").otherwise(F.col("status")))
    return out.withColumn("error", F.when(F.col("_stale"), "stale job reaped").otherwise(F.col("error"))).drop("_stale") if "error" in jobs.columns else out.drop("_stale")


# pages


PAGE = ("workspace_id", "url_hash")


def page_book(fetches: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Pages (workspace_id, url_hash, fetch_count, failure_count, last_error, etag, status) after fetches (workspace_id, url_hash, seq,
    status, error, etag), on top of what is stored of them.

    Errors are counted since the last success; a 304 neither counts nor resets. status is NULL where no answer came; the etag
    is that of the last full answer, none if it had none.
    """
    answered, ok = F.col("status").isNotNull(), F.col("status").between(200, 299) & F.col("error").isNull()
    full = answered & (F.col("status") != 304)
    last_ok = F.max(F.when(ok, F.col("seq"))).alias("last_ok")
    last = F.struct(F.max(F.when(full, F.col("seq"))).alias("seq"), F.max_by("etag", F.when(full, F.col("seq"))).alias("etag")).alias("tag")
    per_page = fetches.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), last_ok, last, F.max_by("status", F.when(answered, F.col("seq"))).alias("seen"))
    errors = plain_join(fetches.filter("error is not null"), per_page.select(*PAGE, "last_ok"), [*PAGE]).filter("last_ok is null or seq > last_ok")
    since = errors.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("failed"), F.substring(F.max_by("error", "seq"), 1, 1000).alias("said"))
    new = per_page.join(since, [*PAGE], "left")
    empty = new.select(*PAGE, F.lit(0).cast("long").alias("fetch_count"), F.lit(0).cast("long").alias("failure_count"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("int").alias("status")).limit(0)
    old = (empty if stored is None else stored).select(*empty.columns)
    reset = F.col("last_ok").isNotNull()
    return old.join(new, [*PAGE], "full").select(
        *PAGE,
        (F.coalesce("fetch_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("fetch_count"),
        (F.when(reset, 0).otherwise(F.coalesce("failure_count", F.lit(0))) + F.coalesce("failed", F.lit(0))).alias("failure_count"),
        F.coalesce("said", F.when(~reset | F.col("last_ok").isNull(), F.col("last_error"))).alias("last_error"),
        F.when(F.col("tag.seq").isNotNull(), F.substring("tag.etag", 1, 512)).otherwise(F.col("etag")).alias("etag"),
        F.coalesce("seen", "status").cast("int").alias("status"),
    )


def breaker(fetches: DataFrame, key: str, order: list[str], failed: Column, limit: int = MAX_FAILURES) -> DataFrame:
    """fetches with streak (failures in a row up to here, by key) and open (the breaker was open before this fetch)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = fetches.withColumn("_island", island).withColumn("_failed", failed.cast("int"))
    streak = F.sum("_failed").over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("streak", streak)
    return out.withColumn("open", F.coalesce(F.lag("streak").over(w) >= limit, F.lit(False))).drop("_island", "_failed")


def refetch(found: DataFrame, pages: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """found (workspace_id, url_hash, via) with fetch: links always, feed and sitemap entries if the page is unknown, no article,
    never fetched or fetched long ago."""
    joined = found.join(pages.select("workspace_id", "url_hash", "is_article", "last_fetched_at"), ["workspace_id", "url_hash"], "left")
    old = F.col("last_fetched_at").isNull() | (F.col("last_fetched_at") < F.lit(as_of - timedelta(hours=hours)))
    return joined.withColumn("fetch", ~F.col("via").isin("feed", "sitemap") | ~F.coalesce("is_article", F.lit(False)) | old)
