import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import mixture

FULL = Tokenizer.from_file(mixture.tokenizer_path())
ENCODE = mixture.encoder(mixture.tokenizer_path())


def plain_ids(text):
    return FULL.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aBzZ éÉßſİŸ÷×'sTdLl\t\n\u0085 \x1c 09%#<|>²½̸́=Σ", max_size=60))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODE(text.encode()), ENCODE.kind).tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "It'S 'TIS don'ts 12a", "<| x |> <|endof text|>", "", "  ", "ÉCOLE façade naïve œuvre Łódź İstanbul", "x" * 5000])
def test_ids_of_odd_texts(text):
    for _ in range(2):
        assert np.frombuffer(ENCODE(text.encode()), ENCODE.kind).tolist() == plain_ids(text)


def test_generations_keep_ids(monkeypatch):
    monkeypatch.setattr(mixture, "REMEMBERED", 5)
    encode = mixture.Encoder(mixture.tokenizer_path())
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choices(["News", "loom!", "wörter", "x1", "dès", "9th", "again", "more,", "日本"], k=6))
        assert np.frombuffer(encode(text.encode()), encode.kind).tolist() == plain_ids(text)


def simulate(tokens, weights, window, grain):
    """Deficit round-robin one window after the other: (queue, token of the queue, window) of each place of the stream."""
    left, served, share = dict(tokens), dict.fromkeys(tokens, 0), dict(weights)
    stream, w = [], 0
    while any(left.values()):
        active = {q: share.get(q, 0) for q in sorted(left) if left[q]}
        if not any(active.values()):
            active = {q: left[q] for q in active}
            share = dict(active)
        deficit, dry = dict.fromkeys(active, Fraction(0)), False
        phase_left = dict(left)
        while not dry:
            for q in active:
                deficit[q] += Fraction(active[q] * window, sum(active.values()))
                while left[q] and active[q] and deficit[q] >= min(grain, left[q]):
                    k = min(grain, left[q])
                    stream += [(q, served[q] + i, w) for i in range(k)]
                    served[q], left[q], deficit[q] = served[q] + k, left[q] - k, deficit[q] - k
                assert left[q] == 0 or deficit[q] < grain
                dry |= active[q] > 0 and phase_left[q] > 0 and left[q] == 0
            w += 1
    return stream


@pytest.mark.parametrize("seed", range(40))
def test_schedule_is_deficit_round_robin(seed):
    rng = random.Random(seed)
    tokens = {f"q{i}": rng.choice([0, 1, 7, 60, 500, 2000]) for i in range(rng.randint(1, 6))}
    weights = tokens if seed % 2 else {q: rng.choice([0, 1, 5, 100]) for q in tokens}
    window, grain = rng.choice([(64, 8), (50, 16), (16, 1), (256, 256)])
    want = simulate(tokens, weights, window, grain)
    schedule = mixture.Schedule(tokens, weights, window, grain)
    got = [None] * sum(tokens.values())
    assert schedule.total == len(want) == len(got)
    for q, n in tokens.items():
        begin = 0
        while begin < n:
            size = min(rng.randint(1, 90), n - begin)
            runs = list(schedule.places(q, begin, size))
            assert sum(r[1] for r in runs) == size
            for offset, length, at, w in runs:
                for i in range(length):
                    assert got[at + i] is None
                    got[at + i] = (q, begin + offset + i, w)
            begin += size
    assert got == want


def test_windows_have_the_target_proportions():
    tokens = {"a": 600_000, "b": 250_000, "c": 150_000}
    schedule = mixture.Schedule(tokens, {"a": 6, "b": 3, "c": 1}, 10_000, 100)
    held = defaultdict(Counter)
    for q, n in tokens.items():
        for _, length, _, w in schedule.places(q, 0, n):
            held[w][q] += length
    for w in range(80):  # b lasts 83 windows
        for q, share in {"a": 6000, "b": 3000, "c": 1000}.items():
            assert abs(held[w][q] - share) <= 100


def test_sequence_starts():
    assert mixture.sequence_starts(0) == [0] and mixture.sequence_starts(1) == [0, 1] and mixture.sequence_starts(2047)[:3] == [0, 1024, 1536]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["news", "loom", "Wörter", "x1", "don't"], k=rng.choice([0, 3, 40, 200, 900]))), rng.choice(["s0", "s0", "s1", "s2", None])) for i in range(150)]
    rows += [(200, None, "s0"), (201, "", "s1"), (5, rows[5][1], "s1"), (None, "a b c", None), (202, "long " * 9000, "rare"), (203, "a<|endoftext|>", "s2")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, window string, part int").repartition(5).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def check(rows, got, capacity):
    """Each id lies in one piece, sequences have no gaps, and only lengths that are powers of two are short of the capacity."""
    texts = Counter((i, tuple([*plain_ids(t or ""), 1]), s) for i, t, s in rows)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.source, r.doc_tokens].append(r)
    for (i, ids, s), times in texts.items():
        mine = [r for r in pieces[i, s, len(ids)] if r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4"))]
        covered = Counter(x for r in mine for x in range(r.start, r.start + r.length))
        same = sum(n for (j, other, z), n in texts.items() if (j, len(other), z) == (i, len(ids), s))
        assert all(times <= covered[x] <= same for x in range(len(ids)))
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids, _), n in texts.items())
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    for places in spots.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0


@pytest.mark.parametrize("weights", [None, {"s0": 0.5, "s1": 0.25, None: 0.25}, {"nowhere": 1}])
def test_pack(spark, table, weights):
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    got = mixture.pack(docs, weights, capacity=512, window=2048, grain=64).collect()
    check(table[1], got, 512)
    if weights is None:
        total = Counter()
        for r in got:
            total[r.source] += r.length
        upto = Counter()
        for w in range(max(r.window for r in got)):
            for r in got:
                if r.window == w:
                    upto[r.source] += r.length
            for s, n in total.items():
                credit = (w + 1) * 2048 * n / sum(total.values())
                assert credit - 64 <= upto[s] <= credit + 1e-6 or upto[s] == n
    assert mixture.pack(docs.filter("false"), weights).count() == 0


def test_weights():
    assert mixture._whole({"a": 0.1, None: 2}) == {"+a": 1, "-": 20}
    with pytest.raises(ValueError):
        mixture._whole({"a": -1})


def test_query(spark, table):
    from newsloom.llm import registry

    got = registry.queries()["op13_mixture_packing"](spark, table[0]).collect()
    check(table[1], got, 2048)
    assert got[0].__fields__[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
