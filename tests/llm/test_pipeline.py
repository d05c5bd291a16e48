import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from newsloom.llm import language, lines, packing, secrets, simhash

WORDS = {"aa": ["the", "and", "tion", "with", "ness", "ly"], "bb": ["über", "schaft", "und", "nicht", "en"]}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        lang = ["aa", "bb"][i % 2]
        body = "\n".join(" ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 4))) for _ in range(12)) for _ in range(8))
        if i % 10 == 3:
            body = rows[-2][1].replace("Home page", "Home  page")
        if i % 7 == 0:
            body += f'\ntoken = "{rng.getrandbits(160):040x}"'
        rows.append((i, ("Home page\n" if i % 3 == 0 else "") + body, lang, f"s{i % 4}", len(body)))
    rows += [(100, None, "aa", "s", None), (101, "1234 !!", "aa", None, 7), (102, "", None, "s", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(cp.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = (before, after)
    before, after = seen["language_id"]
    assert set(before) - set(after) == {100, 101, 102} and all(after[i].text == before[i].text for i in after)
    before, after = seen["line_dedup"]
    assert set(before) == set(after)
    assert all("Home page" not in r.text.split("\n") for r in after.values()) and any("Home page\n" in r.text for r in before.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = seen["near_dedup"]
    fp = {i: simhash.fingerprint(r.text.encode()) for i, r in before.items()}
    root = {i: i for i in fp}
    for _ in fp:
        root = {i: min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4) for i in fp}
    assert set(after) == {i for i in fp if root[i] == i} and len(after) < len(before)
    before, after = seen["secret_scan"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert not secrets.base_spans(r.text.encode()) and (cp.REDACTED in r.text) == bool(secrets.base_spans(before[i].text.encode()))
    packed = cp.best_fit_packing(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(after)
    for r in packed:
        ids = np.array([*packing.encode(after[r.doc_id].text, packing.tokenizer_paths()), 0], "<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())


def test_run_gives_the_last_stage(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.count() > 40 and {"sequence_id", "offset", "ids_crc32"} <= set(out.columns)
    assert language.UNKNOWN == "und" and lines.MIN_DOCS == 10


def test_stages_on_odd_rows(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the weather and the ness with tion " * 9
    rows = [(None, text, None, None, None), (4, text, "aa", "s", 1), (4, text, "aa", "s", 1), (5, None, None, None, None), (None, None, "aa", "s", 1), (6, "", "aa", "s", 0), (7, "word " * 30_000 + "end", "aa", "s", 1)]
    docs = spark.createDataFrame([*rows, *((100 + i, f"{text} own{i}", "aa", "s", 1) for i in range(20))], shape)
    left = {}
    for name, stage in cp.STAGES:
        left[name] = stage(spark, docs, "").collect()
        assert stage(spark, docs.filter("false"), "").count() == 0
    ids = lambda name: sorted((r.doc_id for r in left[name]), key=str)
    assert all(r.text for r in left["language_id"]) and {r.doc_id for r in left["language_id"]} >= {4, 7, None}
    assert len(left["line_dedup"]) == len(left["secret_scan"]) == 27
    assert ids("near_dedup") == sorted([4, 5, 7], key=str) or {4, 7} <= set(ids("near_dedup")) <= {4, 5, 6, 7}
    assert sorted({r.doc_id for r in left["best_fit_packing"]}, key=str) == sorted({r[0] for r in rows} | {100 + i for i in range(20)}, key=str)
