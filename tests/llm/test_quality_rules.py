import random
from collections import Counter

import pytest

from newsloom.llm import quality_rules as q


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    words = words_of(text)
    n, total = len(words), sum(map(len, words))
    covered = lambda at, k: set().union(*(range(i, i + k) for i in at)) if at else set()
    grams = lambda k: [tuple(words[i : i + k]) for i in range(n - k + 1)]
    g3 = grams(3)
    count = Counter(g3)
    repeat = len(covered([i for i, g in enumerate(g3) if count[g] > 1], 3))
    repeated = []
    for k in range(5, 11):
        seen, at = set(), []
        for i, g in enumerate(grams(k)):
            if g in seen:
                at.append(i)
            seen.add(g)
        repeated.append(sum(len(words[i]) for i in covered(at, k)))
    top = []
    for k in (2, 3, 4):
        c = Counter(grams(k))
        most = max(c.values(), default=0)
        top.append(most * max(sum(map(len, g)) for g, m in c.items() if m == most) if most >= q.TOP_TIMES else 0)
    lines = [x for x in text.split("\n") if words_of(x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    return {
        "n_words": n, "word_chars": total, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(later),
        "dup_line_chars": sum(len(w) for x in later for w in words_of(x)), "n_repeat_words": repeat, "repeated_chars": repeated, "top_chars": top,
    }


def make(n, seed):
    rng = random.Random(seed)
    small, large = ["a", "bb", "É#", "the"], [f"w{i}*" if i % 9 == 0 else f"w{i}" for i in range(400)]
    out = ["", "  \n ", None, "one", "x " * 60, "a b c d e f\n" * 20]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 8)):
            line = " ".join(rng.choices(rng.choice([small, large]), k=rng.randint(0, 20)))
            parts += [line] * rng.choice([1, 1, 1, 2, 3])
        out.append(rng.choice(["\n", " ", "\r\n"]).join(parts))
    return out


def test_measures_against_brute_force():
    texts = make(150, 1)
    got = q.measure_block([(t or "").encode() for t in texts])
    for i, text in enumerate(texts):
        assert {k: got[k][i] for k in got} == brute(text), text


@pytest.mark.parametrize("seed", [2])
def test_rules(spark, seed):
    texts = make(60, seed) + ["word " * 3 + " ".join(f"v{i}" for i in range(100))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 1), (0, texts[0], 2)], "doc_id long, text string, kept int")
    rows = q.apply_rules(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        m = brute(texts[r.doc_id] if r.doc_id is not None else "a")
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        over = [100 * c > p * m["word_chars"] for c, p in zip(m["repeated_chars"], q.REPEATED.values(), strict=True)]
        over += [100 * c > p * m["word_chars"] for c, p in zip(m["top_chars"], q.TOP.values(), strict=True)]
        if m["n_dup_lines"] >= 3:
            over += [100 * m["n_dup_lines"] > 30 * m["n_lines"], 100 * m["dup_line_chars"] > 20 * m["word_chars"]]
        assert r.base_failed == failed and r.kept == (not failed and not any(over))
    assert q.apply_rules(docs.filter("false")).count() == 0


def test_long_text():
    text = (" ".join(f"w{i}" for i in range(120000))).encode()
    assert q.measure_block([text, b"a"])["n_words"] == [120000, 1]
