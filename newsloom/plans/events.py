"""Queries over the events table, read as crawl jobs and fetches: time series, streaks, scheduling, windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import stats
from newsloom.session import streamed, table
from newsloom.streaming import windows

AS_OF = datetime(2024, 1, 30, 12)
#: What an event type stands for as a job's status.
STATUS = {"view": "succeeded", "click": "running", "purchase": "pending", "error": "failed"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.as_event_time(table(spark, sf_dir, "events"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    counts = F.from_json("props", "k int")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("source_id"),
        (F.col("user_id") % 5).alias("workspace_id"),
        F.coalesce(names[F.col("event_type")], F.lit("cancelled")).alias("status"),
        F.col("ts").alias("created_at"),
        counts["k"].alias("fetched"),
    )


_STATUS = "CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"
_JOBS = f"SELECT event_id AS id, user_id AS source_id, user_id % 5 AS workspace_id, {_STATUS} AS status, ts AS created_at, CAST(json_extract(props, '$.k') AS INTEGER) AS fetched FROM events"


def events_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_day(events(spark, sf_dir).filter("event_type = 'error'"), "ts", datetime(2024, 2, 3), 40)


def pipeline_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_24h(jobs(spark, sf_dir), AS_OF, ["fetched"])


def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven counters of the last day; two of them stand in a job's JSON, which not every job has."""
    k, n = F.col("fetched"), F.col("id")
    told = F.when(n % 5 != 0, F.to_json(F.struct((k * 3).alias("discovered"), F.when(n % 2 == 0, k % 4).alias("robots_blocked"))))
    rows = jobs(spark, sf_dir).withColumns({"articles": k % 7, "new": F.when(n % 3 != 0, k % 5), "duplicates": k % 3, "failed": F.when(F.col("status") == "failed", 1), "said": F.from_json(told, "discovered long, robots_blocked long")})
    return stats.last_24h(rows.select("*", "said.*"), AS_OF, ["discovered", "fetched", "articles", "new", "duplicates", "failed", "robots_blocked"])


def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest_status(jobs(spark, sf_dir))


def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with counts and last status, by two left joins."""
    j = jobs(spark, sf_dir)
    sources = j.select(F.col("source_id").alias("id")).distinct()
    return stats.source_overview(sources, j.filter("status = 'succeeded'"), j)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    sources = j.groupBy(F.col("source_id").alias("id")).agg((F.max("id") % 2 == 0).alias("enabled"))
    return stats.source_totals(sources, j)


def scheduler_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a scheduler tick starts: each source's next crawl is six hours after its last job; pending jobs of the last
    half day are still active."""
    j = jobs(spark, sf_dir)
    sources = j.groupBy(F.col("source_id").alias("id"), "workspace_id").agg((F.max("created_at") + F.expr("INTERVAL 6 HOURS")).alias("next_crawl_at")).withColumn("enabled", F.col("id") % 4 != 0)
    active = j.filter(F.col("created_at") >= F.lit(datetime(2024, 1, 30, 12)))
    spaces = spark.range(5).select("id", F.lit(60).alias("max_concurrent_crawls"))
    usage = spark.range(5).select(F.col("id").alias("workspace_id"), F.lit(datetime(2024, 1, 31)).cast("date").alias("day"), F.when(F.col("id") == 3, 500).otherwise(10).alias("pages"))
    return stats.dispatch(sources, active.filter("status = 'pending'"), spaces, usage, datetime(2024, 1, 31), 100)


def job_reaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reap(jobs(spark, sf_dir), AS_OF).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def breaker_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of failures of each user as a host, and the fetches that an open breaker would have saved."""
    marked = stats.breaker(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)
    return marked.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if("open").alias("skipped"))


def page_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of pages after all fetches: errors since the last success."""
    fetches = events(spark, sf_dir).select(
        F.lit(0).alias("workspace_id"),
        F.col("user_id").alias("url_hash"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 304).when(F.col("event_type") != "error", 500).alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("etag"),
    )
    return stats.page_book(fetches).select(F.col("url_hash").alias("page"), "fetch_count", "failure_count", "last_error", "etag")


def refetch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users as pages, and as many unknown pages, would be fetched again on the last day."""
    e = events(spark, sf_dir)
    pages = e.groupBy(F.col("user_id").alias("url_hash")).agg(F.max("ts").alias("last_fetched_at"), F.max(F.col("event_type") == "purchase").alias("is_article")).withColumn("workspace_id", F.lit(0))
    via = F.when(F.col("id") % 3 == 0, "link").otherwise("feed")
    found = pages.select(F.explode(F.array("url_hash", -1 - F.col("url_hash"))).alias("id")).select(F.col("id").alias("url_hash"), F.lit(0).alias("workspace_id"), via.alias("via"))
    return stats.refetch(found, pages, datetime(2024, 1, 31), 12).select(F.col("url_hash").alias("page"), "via", "fetch")


def host_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest pause between fetches of each host, in whole seconds."""
    pause = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return events(spark, sf_dir).withColumn("pause", pause).groupBy("user_id").agg(F.min("pause").alias("shortest"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(events(spark, sf_dir), "value")


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windowed(events(spark, sf_dir), "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windowed(events(spark, sf_dir), "2 days", "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(events(spark, sf_dir), "8 hours")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("largest"))


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = windows.daily_usage(jobs(spark, sf_dir).withColumnRenamed("created_at", "ts").withColumnRenamed("fetched", "pages"))
    return usage.select("workspace_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "pages")


def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_usage by a stream: the events table as a file source, read to its end, complete counts in memory."""
    rows = streamed(spark, sf_dir, "events")
    pages = rows.select((F.col("user_id") % 5).alias("workspace_id"), F.col("ts").cast("timestamp").alias("ts"), F.from_json("props", "k int")["k"].alias("pages"))
    name = "usage_stream"
    stream = windows.daily_usage(pages).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name).select("workspace_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "pages")


_DAY = "SELECT workspace_id, strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(fetched) AS BIGINT) AS pages FROM ({}) GROUP BY 1, 2".format(_JOBS)

QUERIES = {
    "events_per_day": (
        events_per_day,
        """SELECT CAST(d.day AS DATE) AS date, coalesce(n, 0) AS count FROM (SELECT unnest(generate_series(DATE '2023-12-26', DATE '2024-02-03', INTERVAL 1 DAY)) AS day) d
LEFT JOIN (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) c ON CAST(c.day AS DATE) = CAST(d.day AS DATE)""",
    ),
    "pipeline_last_24h": (pipeline_last_24h, f"SELECT CAST(coalesce(sum(fetched), 0) AS BIGINT) AS fetched FROM ({_JOBS}) WHERE created_at >= TIMESTAMP '2024-01-29 12:00:00'"),
    "pipeline_counters": (
        pipeline_counters,
        f"""SELECT {", ".join(f"CAST(coalesce(sum({v}), 0) AS BIGINT) AS {c}" for c, v in {"discovered": "CASE WHEN id % 5 <> 0 THEN fetched * 3 END", "fetched": "fetched", "articles": "fetched % 7", "new": "CASE WHEN id % 3 <> 0 THEN fetched % 5 END",
 "duplicates": "fetched % 3", "failed": "CASE WHEN status = 'failed' THEN 1 END", "robots_blocked": "CASE WHEN id % 5 <> 0 AND id % 2 = 0 THEN fetched % 4 END"}.items())} FROM ({_JOBS}) WHERE created_at >= TIMESTAMP '2024-01-29 12:00:00'""",
    ),
    "jobs_by_status": (jobs_by_status, f"SELECT status, count(*) AS jobs FROM ({_JOBS}) GROUP BY status"),
    "latest_status": (latest_status, f"SELECT source_id, arg_max(status, id) AS status FROM (SELECT * FROM ({_JOBS}) ORDER BY id DESC LIMIT 500) GROUP BY source_id"),
    "source_overview": (
        source_overview,
        f"""WITH j AS ({_JOBS}) SELECT s.id, coalesce(a.n, 0) AS articles, l.status AS last_status FROM (SELECT DISTINCT source_id AS id FROM j) s
LEFT JOIN (SELECT source_id, count(*) AS n FROM j WHERE status = 'succeeded' GROUP BY 1) a ON a.source_id = s.id
LEFT JOIN (SELECT source_id, arg_max(status, id) AS status FROM (SELECT * FROM j ORDER BY id DESC LIMIT 500) GROUP BY 1) l ON l.source_id = s.id""",
    ),
    "source_totals": (
        totals,
        f"""WITH j AS ({_JOBS}), s AS (SELECT source_id, max(id) % 2 = 0 AS enabled FROM j GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS sources, (SELECT count(*) FROM s WHERE enabled) AS sources_enabled, (SELECT count(*) FROM j WHERE status IN ('pending', 'running')) AS jobs_active""",
    ),
    "scheduler_due": (
        scheduler_due,
        f"""WITH j AS ({_JOBS}), s AS (SELECT source_id AS id, workspace_id, max(created_at) + INTERVAL 6 HOUR AS nxt FROM j GROUP BY 1, 2), a AS (SELECT * FROM j WHERE status = 'pending' AND created_at >= TIMESTAMP '2024-01-30 12:00:00'),
due AS (SELECT * FROM s WHERE id % 4 <> 0 AND nxt <= TIMESTAMP '2024-01-31' ORDER BY nxt NULLS FIRST, id LIMIT 100), idle AS (SELECT * FROM due WHERE id NOT IN (SELECT source_id FROM a)),
r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY nxt NULLS FIRST, id) AS turn FROM idle), n AS (SELECT workspace_id, count(*) AS n FROM a GROUP BY 1)
SELECT r.id AS source_id, r.workspace_id FROM r LEFT JOIN n USING (workspace_id) WHERE turn + coalesce(n, 0) <= 60 AND r.workspace_id <> 3""",
    ),
    "job_reaper": (
        job_reaper,
        f"SELECT CASE WHEN status IN ('pending', 'running') AND created_at < TIMESTAMP '2024-01-30 10:45:00' THEN 'failed' ELSE status END AS status, count(*) AS jobs FROM ({_JOBS}) GROUP BY 1",
    ),
    "breaker_streaks": (
        breaker_streaks,
        """WITH i AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT *, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i),
o AS (SELECT *, coalesce(lag(streak) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 2, false) AS open FROM s)
SELECT user_id, max(streak) AS longest, count(*) FILTER (open) AS skipped FROM o GROUP BY user_id""",
    ),
    "page_book": (
        page_book,
        """WITH k AS (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS ok, count(*) AS n, max(event_id) FILTER (event_type NOT IN ('error', 'click')) AS tag FROM events GROUP BY 1),
e AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events JOIN k USING (user_id) WHERE event_type = 'error' AND (ok IS NULL OR event_id > ok) GROUP BY 1)
SELECT k.user_id AS page, k.n AS fetch_count, coalesce(e.n, 0) AS failure_count, 'e' || e.last AS last_error, 't' || k.tag AS etag FROM k LEFT JOIN e USING (user_id)""",
    ),
    "refetch_gate": (
        refetch_gate,
        """WITH p AS (SELECT user_id, max(ts) AS last, bool_or(event_type = 'purchase') AS art FROM events GROUP BY 1)
SELECT i AS page, CASE WHEN i % 3 = 0 THEN 'link' ELSE 'feed' END AS via, i % 3 = 0 OR NOT coalesce(art, false) OR last IS NULL OR last < TIMESTAMP '2024-01-30 12:00:00' AS fetch FROM (SELECT DISTINCT unnest([user_id, -1 - user_id]) AS i FROM events) LEFT JOIN p ON p.user_id = i""",
    ),
    "host_pace": (
        host_pace,
        "SELECT user_id, min(s - b) AS shortest FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY user_id",
    ),
    "latency_histogram": (
        latency_histogram,
        "SELECT e AS le, (SELECT count(*) FROM events WHERE value <= e) AS count FROM (VALUES (0.1), (0.25), (0.5), (1.0), (2.0), (5.0), (10.0), (30.0)) t(e) UNION ALL SELECT NULL, count(value) FROM events".replace("e AS le", "CAST(e AS DOUBLE) AS le"),
    ),
    "tumbling_window": (
        tumbling_window,
        "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    ),
    "sliding_window": (
        sliding_window,
        "SELECT strftime(day, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS day FROM events) GROUP BY 1, 2",
    ),
    "session_windows": (
        session_windows,
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY user_id""",
    ),
    "daily_usage": (daily_usage, _DAY),
    "usage_stream": (usage_stream, _DAY),
}
