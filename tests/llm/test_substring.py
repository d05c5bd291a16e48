import random

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from newsloom.llm import substring


def brute(rows):
    """Kept words of each row, by window word sequences in order of (doc_id, start)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = [w.decode() for w in (text or "").encode().split()]
        keep = [True] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(window)
        out[i] = [w for w, k in zip(words, keep, strict=True) if k]
    return out


def make(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["a", "É"]
    passages = [rng.choices(words, k=rng.randint(15, 60)) for _ in range(8)] + [["a"] * 45, ["a", "b"] * 30]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 50))
            cut = rng.randint(0, 5)
            parts.append(p[cut:] if rng.random() < 0.3 else p)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)))
    return rows


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 4), (3, 40)])
def test_against_brute_force(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *c, f=DataFrame.repartitionByRange: f(self, parts, *c))
    rows = [*make(60, seed), (60, None), (61, ""), (62, "a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, factors int").repartition(3)
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == {i: " ".join(w) for i, w in want.items()}
    for i, text in rows:
        n = len((text or "").encode().split())
        assert (got[i].n_words, got[i].n_removed) == (n, n - len(want[i]))
    texts = {i: (t or "").encode().split() for i, t in rows}
    for i, r in got.items():
        for f in r.factors:
            assert texts[i][f.start : f.start + f.words] == texts[f.from_doc][f.from_start : f.from_start + f.words]
            assert f.words >= 20 and (f.from_doc, f.from_start) < (i, f.start)


def test_repeats_null_ids_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (3, "own words " + text), (3, text + " at the end")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, len(r.text.split())) for r in substring.remove_repeats(docs).collect())
    assert got == [(0, 0, 30), (1, 0, 30), (1, 0, 30), (2, 30, 0), (3, 30, 2), (3, 30, 3)]
    assert substring.remove_repeats(docs.filter("false")).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark):
    shared = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"one {shared}"), (1, f"{shared} two")], "doc_id long, text string")
    got = sorted((r.n_removed, r.text) for r in substring.remove_repeats(docs).collect())
    assert [n for n, _ in got] == [0, 30] and got[1][1] in ("one", "two")


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(1 << 30)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join(words[30_000:] + ["own"] * 5), " ".join(["a"] * 30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in substring.remove_repeats(docs).collect()}
    assert got[0][0] == 0 and got[1] == (30_000, "own own own own own") and got[2] == (29_999, "a")


def matches(*hits):
    start, size, *source = np.array(hits, np.int64).reshape(-1, 5).T
    return substring.Matches(start, size, np.stack(source))


def test_parse():
    # a factor goes on while the source does
    assert matches((0, 5, 7, 0, 5), (5, 1, 7, 0, 10)).parse() == [(0, 25, 7, 0, 5)]
    # another source begins across the end: its windows reach beyond and are a factor of their own
    assert matches((0, 5, 7, 0, 5), (5, 1, 7, 0, 10), (6, 1, 8, 0, 0), (7, 3, 8, 0, 1)).parse() == [(0, 25, 7, 0, 5), (6, 23, 8, 0, 0)]
    # the parse goes on behind the end
    assert matches((0, 1, 7, 0, 5), (20, 1, 8, 0, 7), (60, 2, 7, 0, 0)).parse() == [(0, 20, 7, 0, 5), (20, 20, 8, 0, 7), (60, 21, 7, 0, 0)]
    assert matches().parse() == []


def test_spans_are_those_of_all_repeated_windows():
    """The parse steps over windows; with its check of those across factor ends no word of a repeated window is missed."""
    rng = random.Random(9)
    across = 0
    for _ in range(300):
        n = 80
        repeated = sorted(rng.sample(range(n), rng.randint(0, 40)))
        hits, source = [], 0
        for s in repeated:
            source += rng.choice([1, 1, 1, 50])
            hits.append((s, 1, 3, 0, source))
        factors = matches(*hits).parse()
        covered = {w for start, size, *_ in factors for w in range(start, start + size)}
        assert covered == {w for s in repeated for w in range(s, s + substring.WINDOW)}
        assert all(size >= substring.WINDOW for _, size, *_ in factors)
        ends = [start + size for start, size, *_ in factors]
        across += sum(f[0] < e for f, e in zip(factors[1:], ends, strict=False))
    assert across > 100
