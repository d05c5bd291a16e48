import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import packing

PATHS = packing.tokenizer_paths()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aB é’ß'st\n\t 09%#<|> \u0085\x1c", max_size=60))
def test_both_tokenizers_agree(text):
    assert packing.encode(text, PATHS) == Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids


def test_cut_pieces():
    assert packing.cut_pieces(5, 10) == [(0, 5)] and packing.cut_pieces(10, 10) == [(0, 10)]
    assert packing.cut_pieces(23, 10) == [(0, 3), (3, 10), (13, 10)] and packing.cut_pieces(20, 10) == [(0, 10), (10, 10)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_document_once(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 2048][seed % 2]
    lengths = np.minimum(rng.lognormal(np.log(capacity / 4), 1.0, [50, 3000, 20000][seed % 3]).astype(int) + 1, capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    used, total = np.zeros_like(counts), 0
    for times, pattern in packing.plan(counts, capacity):
        assert times > 0 and sum(pattern) <= capacity
        total += times
        for length in pattern:
            used[length] += times
    assert (used == counts).all()
    assert total <= -(-int(lengths.sum()) // capacity) * 1.02 + 2


def test_plan_of_nothing():
    assert packing.plan(np.zeros(65, int), 64) == []


def test_fit_is_a_least_squares_solution():
    counts = np.bincount([40] * 9 + [24] * 5 + [20] * 4 + [4] * 3, minlength=65)
    chosen = packing.patterns(counts, 64)
    assert all(sum(p) == 64 for p in chosen) and (40, 24) in chosen and (40, 20, 4) in chosen
    x = packing.fit(counts, chosen, 500)
    a = np.array([[p.count(n) for p in chosen] for n in range(65)])
    gradient = a.T @ (counts - a @ x)
    assert (x >= 0).all() and (gradient < 1e-2).all() and abs(gradient @ x) < 0.5


@pytest.mark.parametrize("ranked", [1 << 18, 4])
def test_pack(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["news", "loom", "Wörter", "x1"], k=rng.choice([0, 3, 40, 200, 900]))), 1) for i in range(120)]
    rows += [(120, None, 1), (121, "", 1), (5, rows[5][1], 2), (None, "a b c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3)
    got = packing.pack(docs, capacity=512).collect()
    t = Tokenizer.from_file(PATHS[0])
    want = []
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut_pieces(len(ids), 512))]
    key = lambda r: tuple(-1 if x is None else x for x in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 512
    assert len(places) <= -(-sum(r.length for r in got) // 512) * 1.05 + 1
    assert packing.pack(docs.filter("false")).count() == 0
