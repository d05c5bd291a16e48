import random

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash
from newsloom.llm import components as module
from newsloom.llm.components import components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(fps):
    """The least index reachable, by union-find over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", "  \n", "One", "one TWO three", "a b c d", "Ünï cOdé x a b\tc " * 9, "same same same same same same"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_golay_code_is_perfect():
    _, _, errors = simhash.golay()
    assert (errors[:, 0] >= 0).all() and set((errors >= 0).sum(1)) == {1, 6}


def test_links_within_two_share_an_index():
    rng = random.Random(1)
    for _ in range(2000):
        v = rng.getrandbits(22)
        u = v ^ sum(1 << b for b in rng.sample(range(22), rng.randint(0, 2)))
        a, b = simhash.indices(np.array([u, v], np.int64))
        assert set(a[a >= 0]) & set(b[b >= 0])


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(2)
    for _ in range(300):
        v = rng.getrandbits(64)
        u = v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        key, owner = simhash.keys(np.array([u, v], np.uint64))
        assert set(key[owner == 0]) & set(key[owner == 1])


def clustered(n, seed):
    rng = random.Random(seed)
    fps = []
    for _ in range(n):
        base = rng.choice(fps) if fps and rng.random() < 0.8 else rng.getrandbits(64)
        fps.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    return fps


@pytest.mark.parametrize("bucket", [256, 3])
def test_components_of_links(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = list(dict.fromkeys(clustered(150, bucket)))
    rows = [((x ^ (1 << 63)) - (1 << 63),) for x in fps]
    found = components(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()
    got = {r.node & (1 << 64) - 1: r.label for r in found}
    groups = {}
    for x, label in zip(fps, brute_labels(fps), strict=True):
        groups.setdefault(label, set()).add(x)
    for members in groups.values():
        if len(members) > 1:
            assert len({got[x] for x in members}) == 1
        else:
            assert not members & set(got)
    assert len(set(got.values())) == sum(len(m) > 1 for m in groups.values())


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 200])))
        if rows and rng.random() < 0.5:
            text = (rng.choice(rows)[1] or "") + rng.choice(["", " ", " extra"])
        rows.append((i, text, "clash"))
    rows += [(60, None, "x"), (61, "", "x"), (5, rows[5][1], "again"), (None, rows[7][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    labels = brute_labels(fps)
    least = {}
    for (i, _, _), label in zip(rows, labels, strict=True):
        if i is not None:
            least[label] = min(i, least.get(label, i))
    want = sorted((i if i is not None else -1, f"{fp:016x}", least[label]) for (i, _, _), fp, label in zip(rows, fps, labels, strict=True))
    assert got == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    changed = [*words[:-3], "other", "last", "words"]
    docs = spark.createDataFrame([(9, " ".join(words)), (4, " ".join(changed)), (5, "one short text of its own")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {9: 4, 4: 4, 5: 5}


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    parts, real = [], module.cut

    def counted(df):
        out = real(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "cut", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r.node: r.label for r in module.components(spark.createDataFrame([(i + 1, i) for i in range(50)], "u long, v long")).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(51), 0)
    assert max(parts[1:]) == 2
