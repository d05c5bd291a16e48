import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import registry
from newsloom.llm import sentencepiece_codec as sp

PATH = sp.model_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.text(st.characters(codec="utf-8"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(text):
    assert sp.codec(PATH).encode(text) == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_round_trip(text):
    c = sp.codec(PATH)
    assert c.decode(c.encode(text)) == text.replace(sp.MARK, " ")


def test_pieces_next_to_each_other():
    # parts that invite merges across their ends, and runs of spaces, whose merges all have one rank
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "   ", "ing", "É", "\n", "zq", "日本", "😀", "\t", "0", "12", "._", "e", "er", "\x00", "ﬁ", sp.MARK, " " * 17, "=" * 9]
    c = sp.codec(PATH)
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert c.encode(text) == LIBRARY.encode(text)
        marked = sp.MARK + text.replace(" ", sp.MARK)
        assert not text or c.by_word and c.viterbi(marked) == c.encode(text)
    for n in range(1, 80):
        assert c.encode(" " * n) == LIBRARY.encode(" " * n)


def brute(scores, marked, uncovered):
    """Best sums of scores, and their pieces, by trying all pieces."""
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        options = [(best[a][0] + scores[marked[a:end]], best[a][1] + [marked[a:end]]) for a in range(end) if marked[a:end] in scores]
        if marked[end - 1] not in scores:
            options.append((best[end - 1][0] + uncovered, best[end - 1][1] + [marked[end - 1]]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1]


def test_unigram_scores_add_up():
    rng = random.Random(2)
    for _ in range(200):
        names = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(8)} | set("ab")
        pieces = [(p, -rng.uniform(1, 9), i) for i, p in enumerate(sorted(names))]
        c = sp.Codec(pieces, {b: 100 + b for b in range(256)})
        text = "".join(rng.choices("abcü", k=rng.randint(1, 12)))
        want, _ = brute(c.score_of, text, c.uncovered)
        ids = c.viterbi(text)
        letters = [c.text_of[i] for i in ids if i < 100]
        lone = bytes(i - 100 for i in ids if i >= 100).decode()
        assert sum(c.score_of[p] for p in letters) + len(lone) * c.uncovered == pytest.approx(want)
        # bytes for characters without a piece, and for no others
        assert not set(lone) & set(c.score_of)


def test_ties_take_the_longest_last_piece():
    c = sp.Codec([("a", -1.0, 1), ("b", -1.0, 2), ("ab", -2.0, 3)], {ord("c"): 9})
    assert c.viterbi("ab") == [3] and c.viterbi("cab") == [9, 3]


def test_merges_decide_not_sums():
    # ranks: ab, then bc, then abc; "abc" is one piece by merging ab with c
    pieces = [("ab", -1.0, 1), ("bc", -2.0, 2), ("abc", -30.0, 3), ("a", -40.0, 4), ("b", -41.0, 5), ("c", -42.0, 6)]
    c = sp.Codec(pieces, {}, merges=True)
    assert c.viterbi("abc") == [3] and c.viterbi("bcab") == [2, 1] and c.viterbi("aab") == [4, 1] and c.viterbi("bbc") == [5, 2]


def test_documents(spark):
    texts = ["", None, "plain words", "plain words", "has ▁ mark", "x" * 50000 + " end"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "q", 1)], "doc_id long, text string, ids int")
    out = sp.encode_documents(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[2].ids == rows[3].ids
    assert [rows[i].round_trip for i in range(6)] == [True, True, True, True, False, True]
    back = {r.doc_id: r.text for r in sp.decode_documents(out).collect()}
    assert back[5] == texts[5] and back[1] == "" and back[4] == "has   mark"
    assert sp.encode_documents(docs.filter("false")).count() == 0
    assert sp.decode_documents(out.filter("false")).count() == 0
    clash = spark.createDataFrame([(1, None, "x"), (1, [], "x")], "doc_id long, ids array<int>, text string")
    assert [r.text for r in sp.decode_documents(clash).collect()] == ["", ""]


def test_query_has_the_librarys_ids_of_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = registry.queries()["op9_sentencepiece"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = LIBRARY.encode(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.round_trip == (sp.MARK not in texts[r.doc_id])
