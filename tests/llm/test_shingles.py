import random

import numpy as np
import pytest

import corpus_pipeline as cp
from newsloom.llm import shingles, simhash

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    of = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(len(w) - 4, 1))} if t.split() else set()
    a, b = of(a), of(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed=3):
    """Texts with copies that change more and more words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = ["", " \n", "one two", "One two", "one two three"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 40, 120, 400]))]
        for changes in (0, 1, 2, 3, 6):
            text = list(base)
            for _ in range(changes):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    return out


def roots(texts):
    near = [[j for j, u in enumerate(texts) if jaccard(t, u) >= 0.8] for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in near[i]) for i in range(len(texts))]
    return root


def test_jaccard_of_sets():
    texts = corpus()[:40]
    sets = [np.unique(h) for h in shingles.shingle_hashes([t.encode() for t in texts])]
    assert all(shingles.jaccard(a, b) == jaccard(t, u) for a, t in zip(sets, texts, strict=True) for b, u in zip(sets, texts, strict=True))


@pytest.mark.parametrize("seed", [64, 3])
def test_groups_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed)
    # a crowd of texts about as similar as the limit, around one common part
    common = [f"c{i}" for i in range(90)]
    texts += [" ".join([*common, *(f"x{i}y{k}" for k in range(rng.randint(8, 16)))]) for i in range(25)]
    near = simhash.near_texts(spark.createDataFrame([(t,) for t in [*texts, None, texts[9]]], "text string"))
    ids = [r.id for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", shingles.text_id().alias("id")).orderBy("i").collect()]
    label = {r.id: r.label for r in near.collect()}
    root = roots(texts)
    got = {}
    for i, k in enumerate(ids):
        got.setdefault(label.get(k, k), set()).add(i)
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert simhash.near_texts(spark.createDataFrame([], "text string")).count() == 0


def test_stage_links_at_similarity(spark):
    texts = corpus()
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    got = {r.doc_id for r in cp.near_dedup(spark, spark.createDataFrame(rows, SHAPE), "").collect()}
    root = roots(texts)
    assert got == {i for i in range(len(texts)) if root[i] == i}
    fp = [simhash.fingerprint(t.encode()) for t in texts]
    # some of the links are out of reach of fingerprints within four bits
    assert any(jaccard(texts[i], texts[j]) >= 0.8 and (fp[i] ^ fp[j]).bit_count() > 4 for i in range(len(texts)) for j in range(i))


def test_text_with_many_copies_stays_once(spark):
    rng = random.Random(5)
    body = lambda: [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(12)) for _ in range(8)]
    copied = body()
    texts = ["\n".join(copied)] * 24
    texts += ["\n".join(["All rights reserved", *body()]) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], SHAPE)
    cut = cp.line_dedup(spark, docs, "")
    out = {r.doc_id: r.text for r in cut.collect()}
    assert set(out) == set(range(len(texts)))
    assert all(out[i] == texts[i] for i in range(24))
    assert all(out[i] == texts[i].split("\n", 1)[1] for i in range(24, 34))
    assert {r.doc_id for r in cp.near_dedup(spark, cut, "").collect()} == {0, *range(24, 34)}


def test_one_row_for_each_component(spark):
    a, b, c, d = ("\n".join(f"{x}{i} {x}{i + 1}" for i in range(20)) for x in "abcd")
    rows = [
        (None, a, "aa", "s", 1), (None, b, "aa", "s", 1), (7, b, "aa", "s", 1),  # null ids: alone, and after another id
        (None, c, "aa", "s", 1), (None, c, "aa", "s", 1), (None, c, None, "s", 1),
        (5, d, "aa", "s", 1), (5, d, "aa", "s", 1), (5, d + " more", "bb", None, 1),  # one id, repeated and with two texts
        (9, "x y z", "aa", "s", 1), (8, "x y z", "aa", "s", 1), (8, "p q r", "aa", "s", 1), (3, "p q r", "aa", "s", 1),  # 8 heads one group only
    ]
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, spark.createDataFrame(rows, SHAPE), "").collect()]
    five = [t for i, t in got if i == 5]
    assert len(five) == 1 and five[0] in (d, d + " more")
    assert sorted((x for x in got if x[0] != 5), key=str) == sorted([(None, a), (7, b), (None, c), (8, "x y z"), (3, "p q r")], key=str)


@pytest.mark.parametrize("cell", [4, 2048])
def test_far_apart_under_a_crowded_key(spark, monkeypatch, cell):
    monkeypatch.setattr(shingles, "CELL", cell)
    crowd = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    pairs = [(" ".join(f"p{i}x{k}" for k in range(99)), " ".join([*(f"p{i}x{k}" for k in range(97)), "end"])) for i in range(6)]
    texts = [*crowd, *(t for p in pairs for t in p)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select("text", shingles.text_id().alias("id"))
    of = {r.text: r.id for r in docs.collect()}
    order = sorted(of.values())
    assert any(abs(order.index(of[a]) - order.index(of[b])) > shingles.WIDE for a, b in pairs)
    # one key that all share, and others of their own
    own = {t: [7, *(1000 * i + k + 10 for k in range(shingles.BANDS - 1))] for i, t in enumerate(texts)}
    marks = [(of[t], own[t], bytearray(shingles.sketch(shingles.shingle_hashes([t.encode()])[0]))) for t in texts]
    none = spark.createDataFrame([], "u long, v long")
    got = shingles.near_groups(docs, spark.createDataFrame(marks, "id long, keys array<long>, sketch binary"), none)
    want = {of[t]: min(of[a], of[b]) for a, b in pairs for t in (a, b)}
    assert {r.id: r.label for r in got.collect()} == want


def test_sketches_rule_out_no_similar_pair():
    texts = [t.encode() for t in corpus()]
    hashes = shingles.shingle_hashes(texts)
    raw = [np.frombuffer(shingles.sketch(h), np.uint64) for h in hashes]
    for a, x in zip(raw, hashes, strict=True):
        assert a[0] == len(set(x.tolist()))
        for b, y in zip(raw, hashes, strict=True):
            assert int(np.bitwise_count(a[1:] ^ b[1:]).sum()) <= len(set(x.tolist()) ^ set(y.tolist()))
