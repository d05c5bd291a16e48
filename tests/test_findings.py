"""Queries of the store on ids and pages that the smallest tables lack."""

import re

import duckdb
import pytest

from newsloom import registry
from newsloom.operators import dedup, search


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query and of its SQL over one table, made by SQL."""

    def run(name, table, sql):
        con = duckdb.connect()
        con.execute(f"CREATE TABLE {table} AS {sql}")
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        got = registry.queries()[name](spark, str(tmp_path))
        found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, found))

    return run


def test_public_ips_of_great_ids(against_sql):
    got, want = against_sql("public_ips", "customer", "SELECT x AS c_custkey, 'n' AS c_name, 1 AS c_nationkey, 's' AS c_mktsegment FROM (SELECT unnest(range(-30, 30)) UNION ALL SELECT unnest(range(65530, 65560)) UNION ALL SELECT unnest(range(5400000, 5400020)) UNION ALL SELECT NULL) t(x)")
    assert len(got) == 111 and got == want


def test_page_traces_of_one_short_paragraph(against_sql):
    html = '<html lang="de"><head><title>A short one. Nothing more.</title></head><body><nav><a href="/x">X</a></nav><article><h1>A short one. Nothing more.</h1><p><b>A short one. Nothing more.<br></article><footer>© site</footer></body></html>'
    got, want = against_sql("page_traces", "pages", f"SELECT 1::BIGINT AS page_id, 'https://site.example/de/1' AS url, '{html}' AS html")
    assert got == want


def test_articles_without_hash_make_few_links(spark, monkeypatch):
    most, real = [0], dedup.cut

    def counted(df):
        out = real(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(dedup, "cut", counted)
    rows = [(0, i, None, 7 if i != 50 else 8) for i in range(1, 301)]
    got = {r.id: (r.outcome, r.duplicate_of, r.distance) for r in dedup.resolve(spark.createDataFrame(rows, "workspace_id long, id long, content_hash string, simhash long")).collect()}
    # 8 is four bits from 7
    assert got == {1: ("new", None, None), 50: ("new", None, None)} | {i: ("near_duplicate", 1, 0) for i in range(2, 301) if i != 50}
    assert most[0] <= 300


@pytest.mark.parametrize("name", ["near_pairs", "resolve"])
def test_fingerprints_are_made_once(spark, name):
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def costly(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([(0, i, f"h{i}", 1 << i) for i in range(20)], "workspace_id long, id long, content_hash string, f long")
    getattr(dedup, name)(rows.withColumn("simhash", costly("f"))).collect()
    assert made.value == 20


def test_term_frequencies_of_shared_and_missing_ids(against_sql):
    texts = "(1, 'a b a _c'), (1, 'B d'), (1, 'b'), (2, 'b ÄÖ ä'), (NULL, 'a e e'), (NULL, 'a'), (NULL, NULL), (3, NULL), (4, ''), (5, '- a')"
    got, want = against_sql("term_frequencies", "documents", f"SELECT x::BIGINT AS doc_id, t AS text, 'en' AS lang, 's' AS source, 1 AS n_chars FROM (VALUES {texts}) t(x, t)")
    assert "('e', 0, 2)" in got and "('b', 2, 4)" in got and got == want


def test_term_frequencies_meet_by_word_alone(spark):
    rows = spark.range(2000).selectExpr("id", "'some words that all rows have' AS body").repartition(3)
    plan = search.term_counts(rows)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert keys and all(re.fullmatch(r"term#\d+", k) for k in keys)
