"""Queries that SQL can't express, against plain Python on a small table."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_secrets import brute_base
from test_simhash import brute_fingerprint, brute_labels
from tokenizers import Tokenizer

from newsloom.llm import packing, registry, tiff


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"en": ["the", "weather", "tion", "and"], "fr": ["être", "les", "une", "çois"]}
    rows = []
    for i in range(120):
        lang = ["en", "fr"][i % 2]
        text = " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(rng.choice([1, 3, 40, 400])))
        if i % 9 == 4:
            text = rows[-2][1] + rng.choice(["", " extra"])
        if i % 5 == 0:
            text += f' é API_KEY: "{rng.getrandbits(80):020x}" AKIA{"X1" * 8}'
        rows.append((i, text, lang))
    rows += [(200, None, "en"), (201, "", None), (202, "12 ##", "fr"), (203, "long " * 9000, "en")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, g, f"s{i % 3}", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 4 != 0, 0) for i in range(0, 120, 2)], "doc_id long, q boolean, toxic int").selectExpr("doc_id", "cast(q as int) quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def run(spark, table, name):
    return {r.doc_id: r for r in registry.queries()[name](spark, table[0]).collect()}


def test_op1(spark, table):
    got = run(spark, table, "op1_secret_scan")
    assert len(got) == len(table[1])
    for i, text, _ in table[1]:
        base = brute_base(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, _, k in base) for x in ("assign", "access", "hex")]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if not s.startswith("crf:")] == (listed.split(",") if listed else [])


def test_op2(spark, table):
    got = run(spark, table, "op2_simhash_near_dedup")
    fps = [brute_fingerprint(t) for _, t, _ in table[1]]
    groups = defaultdict(list)
    for (i, _, _), label in zip(table[1], brute_labels(fps), strict=True):
        groups[label].append(i)
    for (i, _, _), fp, label in zip(table[1], fps, brute_labels(fps), strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", min(groups[label]))


def test_op3(spark, table):
    got = run(spark, table, "op3_tiff_media")
    for i, text, _ in table[1]:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = tiff.payload_tiff(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"64x{len(payload) // 192}:")


def test_op8(spark, table):
    got = run(spark, table, "op8_language_id")
    right = []
    for i, text, lang in table[1]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if text is None or not any(c.isalpha() for c in text):
            assert got[i].lang_pred == "und"
        else:
            assert got[i].lang_pred in ("en", "fr") and 0 <= got[i].score <= 1
            right.append(got[i].lang_pred == lang)
    assert np.mean(right) > 0.95


def test_op10(spark, table):
    rows = registry.queries()["op10_best_fit_packing"](spark, table[0]).collect()
    t = Tokenizer.from_file(packing.tokenizer_paths()[0])
    want = set()
    for i, text, _ in table[1]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        cuts = [0, *range(n % 2048 or 2048, n, 2048), n] if n > 2048 else [0, n]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {tuple(r[:5]) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        ends = np.cumsum([n for _, n in sorted(spots)])
        assert [o for o, _ in sorted(spots)] == [0, *ends[:-1]] and ends[-1] <= 2048
    room = []
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [k for k, free in enumerate(room) if free >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(2048 - n)
    assert len(places) <= len(room)


def test_op6_and_op9(spark, table):
    got = run(spark, table, "op6_quality_cotraining")
    assert len(got) == len(table[1]) and all(0 <= r.score <= 1 for r in got.values())
    got = run(spark, table, "op9_sentencepiece")
    assert len(got) == len(table[1]) and all(r.round_trip for r in got.values()) and got[200].n_tokens == 0
