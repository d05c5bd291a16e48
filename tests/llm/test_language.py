import random

import numpy as np

from newsloom.llm import language

WORDS = {"aa": ["the", "and", "tion", "with", "ness"], "bb": ["über", "schaft", "und", "nicht"], "cc": ["être", "une", "çois", "que"]}


def text(lang, rng, n=80):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_gradients():
    rng = np.random.default_rng(1)
    net = language.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, language.CLASSES, (5, language.WINDOW)).astype(np.uint8), rng.integers(0, 2, 5)
    g, _ = net.step(x, y)
    for k in net.p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            if k == "e":
                at = (int(x[0, 3]), at[1])
            old, eps = net.p[k][at], 1e-5
            net.p[k][at] = old + eps
            up = net.step(x, y)[1]
            net.p[k][at] = old - eps
            down = net.step(x, y)[1]
            net.p[k][at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3


def test_tables_give_the_network():
    rng = np.random.default_rng(2)
    net = language.Network(["a", "b", "c"])
    x = rng.integers(0, language.CLASSES, (300, language.WINDOW)).astype(np.uint8)
    pooled = []
    for w in language.WIDTHS:
        m = language.WINDOW - w + 1
        response = sum(net.p["e"][x[:, j : j + m]] @ net.p[f"w{w}"][j] for j in range(w)) + net.p[f"b{w}"]
        pooled.append(np.maximum(response.max(1), 0))
    z = np.concatenate(pooled, 1) @ net.p["v"] + net.p["c"]
    q = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(net.predict(x, net.tables()), q / q.sum(1, keepdims=True), atol=1e-4)


def test_windows_cover_whole_texts():
    x, n = language.windows([b"", b"a", b"b" * 192, b"c" * 193])
    assert n.tolist() == [0, 1, 1, 2] and x.shape == (4, language.WINDOW)


def test_identify(spark):
    rng = random.Random(3)
    rows = [(i, text(lang, rng, rng.choice([3, 80, 400])), lang) for i in range(240) for lang in [list(WORDS)[i % 3]]]
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (None, rows[0][1], "aa"), (903, rows[1][1], None), (1, rows[1][1], "bb")]
    docs = spark.createDataFrame([(i, t, g, "x") for i, t, g in rows + extra], "doc_id long, text string, lang string, score string").repartition(4)
    got = language.identify(docs).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0
    assert by_id[903].lang_pred == by_id[1].lang_pred and by_id[903].score == by_id[1].score
    out = [r for r in got if r.doc_id is not None and r.doc_id < 240 and len(r.text) > 100]
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(docs).collect()] == ["und"]
    assert language.identify(docs.filter("false")).count() == 0


def test_held_out_documents_teach_nothing(spark):
    from zlib import crc32

    docs = spark.createDataFrame([(i, f"text {i}", "aa") for i in range(200)], "doc_id long, text string, lang string")
    sample = language.training_sample(docs)
    held = {f"text {i}".encode() for i in range(200) if crc32(str(i).encode()) % 4 == 2}
    assert sample and held and not held & {w.rstrip() for _, w in sample}


def test_windows_are_drawn_from_whole_texts():
    text = b"".join(bytes([97 + i % 26]) * 192 for i in range(2000)) + b"z"
    every = language._drawn(text, 5, 1.0)
    assert every == text.ljust(2001 * 192)
    some = language._drawn(text, 5, 0.1)
    assert 120 < len(some) // 192 < 300 and some != language._drawn(text, 6, 0.1)
    at = [i for i in range(2000) if language._drawn(text[: 192 * (i + 1)], 5, 0.1) != language._drawn(text[: 192 * i], 5, 0.1)]
    assert min(at) < 100 and max(at) > 1900
    assert language._drawn(b"", 1, 1.0) == language._drawn(b"123", 1, 1.0) == b"" and language._drawn(b"ab", 1, 1.0) == b"ab".ljust(192)


def test_the_sample_is_bounded_by_language(spark):
    rows = [(i, "abc " * (200 if i % 7 else 20_000), "aa" if i % 5 else "bb") for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, "text", None), (None, "text", "cc")], "doc_id long, text string, lang string")
    sample = language.training_sample(docs, 300)
    n = {g: sum(len(w) // 192 for x, w in sample if x == g) for g in ("aa", "bb")}
    assert all(200 < k < 400 for k in n.values()) and {g for g, _ in sample} == {"aa", "bb"}


def test_ties_and_long_texts(spark):
    net = language.Network(["aa", "bb"])
    net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
    docs = spark.createDataFrame([(1, "word " * 100_000), (2, "x"), (2, "x")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, net).collect()] == [("aa", 0.5)] * 3


def test_held_out_is_never_null(spark):
    docs = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    assert {r.h for r in docs.select(language.held_out().alias("h")).collect()} <= {True, False}
