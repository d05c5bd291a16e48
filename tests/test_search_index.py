import random

import pytest

from newsloom.operators import search as s
from newsloom.streaming.search_index import SearchIndex

SHAPE = "id long, workspace_id long, title string, description string, body string, published_at timestamp, duplicate_of_id long"
WORDS = ["harbour", "vote", "budget", "the", "of", "town", "quay", "delayed", "Ünal", "1999"]


def made(ids, rng):
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    return {i: (i, 1, say(2), None if i % 3 else say(2), say(rng.choice([0, 3, 20])), None, None) for i in ids}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Four batches: new articles, updates and new ones, removals, nothing."""
    rng = random.Random(8)
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), bucket_rows=20, fan=2)
    frame = lambda rows: spark.createDataFrame(list(rows.values()), SHAPE)
    states = []
    held = made(range(20), rng)
    index.update(frame(held), None, 0)
    states.append(dict(held))
    changed = made([*range(5, 9), *range(20, 26)], rng)
    index.update(frame(changed), frame({i: held[i] for i in changed if i in held}), 1)
    held |= changed
    states.append(dict(held))
    index.update(frame({}), frame({i: held[i] for i in (2, 6)}), 2)
    held = {i: row for i, row in held.items() if i not in (2, 6)}
    states.append(dict(held))
    index.update(frame({}), None, 3)
    states.append(dict(held))
    return index, states, frame


@pytest.mark.parametrize("state", [1, 3])
def test_updated_index_equals_a_fresh_one(stored, state):
    index, states, frame = stored
    articles = frame(states[state])
    want = sorted((r.term, r.id, r.field, round(r.weight, 3), tuple(r.positions)) for r in s.postings(articles).collect())
    assert sorted((r.term, r.id, r.field, round(r.weight, 3), tuple(r.positions)) for r in index.table.rows(state + 1).collect()) == want
    for q in ('"the quay" or Ünal', "harbour budget -of", "-town"):
        query = s.SearchQuery(workspace_id=1, q=q, sort="relevance", limit=30)
        fresh = s.search(articles, query, "fulltext")
        page = index.search(articles, query, state + 1)
        assert [(r.id, r.rank) for r in page.items.collect()] == [(r.id, r.rank) for r in fresh.items.collect()] and page.total.first() == fresh.total.first()


def test_a_search_reads_its_words_buckets(spark, tmp_path):
    read = []
    for size in (50, 1500):
        index = SearchIndex(spark, str(tmp_path / str(size)), bucket_rows=100)
        rows = [(i, 1, f"word{i} other{i}", None, "rare" if i == 7 else "", None, None) for i in range(size)]
        index.update(spark.createDataFrame(rows, SHAPE), None, 0)
        found = index.postings("rare word7", 1)
        assert {(r.term, r.id) for r in found.collect()} == {("rare", 7), ("word7", 7)}
        read.append(spark.read.parquet(*found.inputFiles()).count())
    assert read[1] < 4 * 100 and read[1] < 1500  # of 3,001 postings


def test_no_words_and_counts(stored):
    index, states, frame = stored
    articles = frame(states[-1])
    assert index.search(articles, s.SearchQuery(workspace_id=1, limit=5), 4).total.first().total == len(states[-1])
    counts = {r.term: (r.docs, r.places) for r in index.term_counts("harbour zebra", 4).collect()}
    texts = [" ".join(x or "" for x in row[2:5]).lower().split() for row in states[-1].values()]
    assert counts == {"harbour": (sum("harbour" in t for t in texts), sum(t.count("harbour") for t in texts))}
