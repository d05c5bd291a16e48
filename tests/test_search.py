from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.operators import search as s

ROWS = [
    (1, 1, 7, "Budget vote delayed", None, "The council put off the vote on the new budgets of the town.", "en", "local", datetime(2024, 5, 1), 0.9, None),
    (2, 1, 7, "Harbour plan", "Budgets again", "A plan for the old quay, 100% done_so far.", "en", "local", datetime(2024, 5, 2), 0.6, None),
    (3, 1, 8, "Copy", None, "The council put off the vote.", "en", None, None, 0.4, 1),
    (4, 2, 9, "Other tenant", None, "budget budget budget", "de", "local", datetime(2024, 5, 3), 0.9, None),
    (5, 1, None, None, None, None, None, None, None, None, None),
]
SHAPE = "id long, workspace_id long, source_id long, title string, description string, body string, language string, category string, published_at timestamp, confidence double, duplicate_of_id long"


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ROWS, SHAPE)


def ids(page):
    return [r.id for r in page.items.collect()]


def run(articles, backend="fulltext", **kw):
    return s.search(articles, s.SearchQuery(**kw), backend)


@pytest.mark.parametrize("backend", ["fulltext", "like"])
def test_both_backends(articles, backend):
    page = run(articles, backend, workspace_id=1, q="budgets")
    assert set(ids(page)) == {1, 2} and page.total.first().total == 2 and page.backend == backend
    assert ids(run(articles, backend, workspace_id=1, q="zebra")) == []
    assert ids(run(articles, backend, workspace_id=1)) == [2, 1, 5]
    assert ids(run(articles, backend, workspace_id=1, include_duplicates=True)) == [2, 1, 5, 3]
    assert ids(run(articles, backend, workspace_id=1, limit=1, offset=1)) == [1]


def test_filters(articles):
    f = lambda **kw: ids(run(articles, "like", workspace_id=1, **kw))
    assert f(language="EN") == [2, 1] and f(source_id=7, category="local") == [2, 1]
    assert f(since=datetime(2024, 5, 2)) == [2] and f(until=datetime(2024, 5, 2)) == [1] and f(min_confidence=0.7) == [1]


def test_like_escapes(articles):
    assert ids(run(articles, "like", q="100% done_so")) == [2] and ids(run(articles, "like", q="100_ done%so")) == []


def test_query_grammar(articles):
    assert s.parse_query('one -two or "three four" -"five six"') == [[(True, ["one"]), (False, ["two"])], [(True, ["three", "four"]), (False, ["five", "six"])]]
    f = lambda q: set(ids(run(articles, q=q)))
    assert f('"the vote"') == {1} and f("council -copy") == {1} and f("quay or tenant") == {2, 4} and f("-") == set() and f('"vote the"') == set()


def test_rank(articles):
    page = run(articles, q="budget", sort="relevance")
    assert ids(page) == [1, 4] and {r.id for r in page.scores.collect()} == {1, 4}


def test_cover_density():
    half = [(0, "a", 1.0), (3, "b", 0.2), (4, "a", 0.2), (9, "b", 0.2)]
    pair = lambda v, w, between: 2 / (1 / v + 1 / w) / (1 + between)
    assert s.cover_density(half, [{"a", "b"}]) == pytest.approx(pair(1.0, 0.2, 2) + pair(0.2, 0.2, 0) + pair(0.2, 0.2, 4))
    assert s.cover_density(half, [{"a"}]) == pytest.approx(1.2) and s.cover_density(half, [{"a", "z"}]) == 0
    assert s.cover_density([(0, "a", 1.0), (1, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0)], [{"a", "b", "c"}]) == pytest.approx(1.0)


def test_stored_index_gives_the_same(articles, spark, tmp_path):
    s.postings(articles).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for q in ('"the vote" or budgets', "-vote", "council -copy", "budget", "-", '"100 done_so"'):
        query = s.SearchQuery(workspace_id=1, q=q, include_duplicates=True, sort="relevance")
        assert [r.asDict() for r in s.search(articles, query, index=index).items.collect()] == [r.asDict() for r in s.search(articles, query, "fulltext").items.collect()]
    assert s.search(articles, s.SearchQuery(q="x"), index=index).backend == "fulltext" and s.search(articles, s.SearchQuery(q="x")).backend == "like"
    assert set(ids(run(articles, q="-vote", workspace_id=1))) == {2, 5}


def test_term_counts(articles):
    got = {r.term: (r.docs, r.places) for r in s.term_counts(articles).collect()}
    assert got["budget"] == (1, 3) and got["the"] == (3, 4 + 1 + 2)


def test_registry(articles):
    s.register_backend("none", lambda a, q, i: s.SearchPage(a.limit(0), a.limit(0), "none"))
    assert ids(run(articles, "none")) == []
    with pytest.raises(KeyError):
        run(articles, "nowhere")
    with pytest.raises(ValueError, match="limit"):
        s.SearchQuery(limit=0)


def test_postings(articles):
    rows = {(r.term, r.id, r.field): r.positions for r in s.postings(articles).collect()}
    # three words of the title, and two, come before the body
    assert rows["the", 1, "body"] == [3, 7, 10, 14][: len(rows["the", 1, "body"])] and rows["budget", 4, "body"] == [2, 3, 4] and rows["budgets", 2, "description"] == [2]


def test_filters_reach_the_scan(spark, articles, tmp_path):
    articles.write.parquet(str(tmp_path / "a"))
    plan = s.apply_filters(spark.read.parquet(str(tmp_path / "a")), s.SearchQuery(workspace_id=1, language="en")).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(workspace_id,1)" in plan and "EqualTo(language,en)" in plan and "body" not in plan.split("ReadSchema")[-1]
    assert F.lit(1) is not None


def test_postings_take_no_exchange(spark):
    articles = spark.createDataFrame([(1, "A b", None, "x a X b")], "id long, title string, description string, body string")
    found = s.postings(articles)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.term, r.field, r.positions) for r in found.collect()) == [("a", "body", [3]), ("a", "title", [0]), ("b", "body", [5]), ("b", "title", [1]), ("x", "body", [2, 4])]
