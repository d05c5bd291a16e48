import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import cotraining as c


def make(n, seed):
    """(doc_id, text, source, lang, n_chars, label): the words tell the label, and so do lines and sources, less surely."""
    rng = random.Random(seed)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}#" for i in range(30)]
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.7)
        words = rng.choices(good if label or rng.random() < 0.2 else bad, k=rng.randint(20, 80))
        short = (not label) != (rng.random() < 0.1)
        text = "".join(w + (".\n" if k % (3 if short else 12) == 0 else " ") for k, w in enumerate(words))
        source = rng.randrange(0, 40, 2) + (label if rng.random() < 0.9 else 1 - label)
        rows.append((i, text, f"site{source}", "en", len(text), label))
    return rows


def table(rows):
    arrays = c._feature_arrays([r[1].encode() for r in rows], *([r[k] for r in rows] for k in (2, 3, 4)))
    return pa.Table.from_arrays(arrays, ["bucket", "count", "place", "dense"])


def test_score_documents(spark):
    rows = make(600, 1)
    odd = [(900, None, None, None, None), (901, "", "x", "en", -1), (None, rows[0][1], "news", "en", 5), (0, *rows[0][1:5]), (902, "g1 " * 200_000, "news", "en", 600_000)]
    docs = spark.createDataFrame([r[:5] for r in rows] + odd, "doc_id long, text string, source string, lang string, n_chars long").withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows if r[0] % 2] + [(1, None, 0), (None, 1, 0), (2, 7, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = c.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    unseen = [r for r in rows if r[0] % 2 == 0]
    assert np.mean([by_id[r[0]].keep == bool(r[5]) for r in unseen]) > 0.9
    assert all(0 <= r.score <= 1 and 0 <= r.text_score <= 1 and 0 <= r.meta_score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert c.score_documents(docs.filter("false"), labels).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_without_labels_of_both_kinds_all_are_kept(spark, labels):
    docs = spark.createDataFrame([(1, "a", "s", "en", 1), (2, "b", None, None, None)], "doc_id long, text string, source string, lang string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert [(r.score, r.keep) for r in c.score_documents(docs, known).collect()] == [(0.5, True)] * 2


def test_scores_dont_depend_on_neighbours():
    rows = make(120, 2)
    x = table(rows)
    model = c.learn(x, np.array([r[5] for r in rows], float))
    together = model.score(c.views(x))
    for i in range(0, 120, 17):
        alone = model.score(c.views(x.slice(i, 1)))
        assert np.allclose([a[0] for a in alone], [t[i] for t in together], rtol=1e-12, atol=0)
    # features of a block are those of its texts one by one
    single = pa.concat_tables([table([r]) for r in rows])
    for name in ("bucket", "count", "place", "dense"):
        assert single.column(name).to_pylist() == x.column(name).to_pylist()


def test_layout_and_words_of_a_small_text():
    words = c.Words([b"Aa bb aa.\n\nx y!", b"", b"bb bb"])
    layout = c.layout_features(words)
    assert np.allclose(layout[0], [np.log1p(3), np.log1p(13 / 3), np.log1p(9), 1 / 3, 2 / 3])
    assert np.allclose(layout[1], [np.log1p(1), 0, 0, 1, 0])
    of, _, count, dense = c.text_features(words)
    assert np.bincount(of, count, 3).tolist() == [5, 0, 2] and dense[:, -1].tolist() == [0, 1, 0]
    assert dense[2, -3] == 0.5 and dense[0, 5] == 2 / 15


def test_gradient_is_that_of_the_loss():
    rows = make(40, 4)
    x, y = c.views(table(rows))[c.PAGE], np.array([r[5] for r in rows], float)
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.1, x.width + x.dense.shape[1] + 1)
    loss = lambda w: np.log1p(np.exp(-np.where(y == 1, 1, -1) * x.dot(w))).sum()
    g = x.gradient(1 / (1 + np.exp(-x.dot(w))) - y)
    for k in [*rng.integers(0, len(w), 10), len(w) - 1]:
        step = np.eye(len(w))[k] * 1e-5
        assert (loss(w + step) - loss(w - step)) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-4)


def accuracy(model, rows):
    text, page, both = model.score(c.views(table(rows)))
    y = np.array([r[5] for r in rows])
    return [((p >= 0.5) == y).mean() for p in (text, page, both)]


def test_rounds_dont_lose():
    """Held-out labels accept what a round teaches, so their loss falls or stays; on others the views get no worse."""
    gains = []
    for seed in range(6):
        rows = make(2700, seed)
        few, pool, test = rows[:240], rows[240:1700], rows[1700:]
        known, y = table(few), np.array([r[5] for r in few], float)

        def search(model, ones, turn, pool=pool):
            x = table(pool)
            scores = model.score(c.views(x))
            rng, most = np.random.default_rng(turn), {0: round(c.PER_ROUND * (1 - ones)), 1: round(c.PER_ROUND * ones)}
            found = [(i, v, k) for v in (0, 1) for k in (0, 1) for i in rng.permutation(np.flatnonzero((scores[v] if k else 1 - scores[v]) >= c.SURE))[: most[k]]]
            at, view, label = (np.array(a, np.int64) for a in zip(*found, strict=True))
            return x.take(pa.array(at)), view, label

        without, with_ = c.learn(known, y), c.learn(known, y, search)
        assert all(b[0] <= a[0] and b[1] <= a[1] and b[2] <= a[2] for a, b in zip(with_.losses, with_.losses[1:], strict=False))
        gains.append(np.array(accuracy(with_, test)) - accuracy(without, test))
    # a point of the sum is within its calibration by 80 held-out labels
    assert np.mean(gains, 0)[c.PAGE] > 0 and np.min(gains, 0)[c.PAGE] >= 0 and np.min(gains) > -0.02 and np.mean(gains, 0).min() > -0.005


def test_search_covers_all_rows_and_copies_count_once(spark):
    rows = make(300, 7)
    docs = [r[:5] for r in rows] + [(1000 + i, *rows[3][1:5]) for i in range(200)] + [(None, *rows[8][1:5])]
    frame = c.features(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long"))
    model = c.learn(table(rows[:200]), np.array([r[5] for r in rows[:200]], float))
    known = np.arange(0, 100)
    search = c.pool_search(frame.repartition(5), known, per_round=10**6, sure=0.8)
    found, view, label = search(model, 0.5, 0)
    keys = {(v, k, key) for v, k, key in zip(view.tolist(), label.tolist(), found.column("key").to_pylist(), strict=True)}
    everything = [r for r in frame.collect() if r.doc_id is None or r.doc_id >= 100]
    x = pa.Table.from_pylist([r.asDict() for r in everything], pa.schema([("bucket", pa.list_(pa.int32())), ("count", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())), ("dense", pa.list_(pa.float32()))]))
    p = model.score(c.views(x))
    want = {(v, k, r.key) for v in (0, 1) for k in (0, 1) for r, q in zip(everything, p[v], strict=True) if (q if k else 1 - q) >= 0.8}
    assert keys == want and len(found) == len(want)
    few = c.pool_search(frame, known, per_round=8, sure=0.8)(model, 0.75, 1)
    assert np.bincount(few[1] * 2 + few[2], minlength=4).max() <= 6 and few[0].num_rows > 0
