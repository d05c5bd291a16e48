from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions import display, http

NOW = datetime(2024, 5, 10, 12)


def col(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression).collect()]


def test_kinds(spark):
    df = spark.createDataFrame([("text/html; charset=x", ""), ("", " <!DOCTYPE html><p>"), (None, "<HTML>"), ("", "plain"), ("image/png", "<html>")], "t string, c string")
    assert [r[0] for r in df.select(http.is_html("t", "c")).collect()] == [True, True, True, False, False]
    shell = "<div id='root'></div><script>"
    assert col(spark, [shell, "<p>x</p>", "<script>" * 10], http.needs_script("v", F.lit(0))) == [True, False, True]
    assert col(spark, [shell], http.needs_script("v", F.lit(500))) == [False]


def test_retries(spark):
    assert col(spark, [1, 2, 9], http.backoff_seconds("v", 1.0), "int") == [0.5, 1.0, 30.0]
    assert col(spark, [1], http.backoff_seconds("v", 0.0), "int") == [0.25]
    headers = ["7", "Fri, 10 May 2024 12:00:30 GMT", "Fri, 10 May 2024 11:00:00 GMT", "9999", "soon", None]
    assert col(spark, headers, http.retry_after_seconds("v", F.lit(NOW))) == [7.0, 30.0, 0.0, None, None, None]


def test_sources(spark):
    raw = spark.createDataFrame([(1, 7, "old"), (2, 7, "né"), (3, 8, None)], "id long, article_id long, html string").select("id", "article_id", http.gzip_text("html").alias("content"))
    assert {r.article_id: r.html for r in http.newest_source(raw).collect()} == {7: "né", 8: None}
    assert col(spark, [bytearray(b"bad")], http.gunzip_text("v"), "binary") == [None]


def test_display(spark):
    times = [datetime(2024, 5, 10, 11, 59, 30), datetime(2024, 5, 10, 11, 30), datetime(2024, 5, 10, 15), datetime(2024, 5, 8), datetime(2023, 1, 2)]
    assert col(spark, times, display.relative_time("v", F.lit(NOW)), "timestamp") == ["now", "30m ago", "in 3h", "2d ago", "2023-01-02"]
    assert col(spark, [45.0, 200.0, 7500.0], display.duration("v"), "double") == ["45s", "3m 20s", "2h 5m"]
    assert col(spark, [0.123, 1.0], display.percent("v"), "double") == ["12%", "100%"]
    assert col(spark, ["daily_quota", "odd"], display.stop_reason("v")) == ["daily quota", "odd"]
    assert col(spark, [-1, 10], display.signature("v"), "long") == ["f" * 16, "000000000000000a"]
