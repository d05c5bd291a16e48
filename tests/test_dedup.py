import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup
from newsloom.streaming.incremental import STORE

NODES = "workspace_id long, id long, content_hash string, simhash long"
ARRIVALS = "workspace_id long, arrival long, canonical_url string, title string, body string, confidence double"


def bits(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


class Sequential:
    """The store as it is filled one arrival after the other."""

    def __init__(self, stored=(), limit=3):
        self.rows = {r["id"]: dict(r) for r in stored}
        self.limit = limit

    def take(self, ws, url, title, content_hash, simhash, confidence, next_id):
        mine = [r for r in self.rows.values() if r["ws"] == ws]
        held = next((r for r in mine if url is not None and r["url"] == url), None)
        if held:
            if (held["hash"], held["title"]) == (content_hash, title) or confidence + 0.1 < held["confidence"]:
                return "unchanged", None, None
            held.update(title=title, hash=content_hash, fp=simhash, confidence=confidence)
            return "updated", None, None
        originals = sorted((r for r in mine if r["dup"] is None), key=lambda r: r["id"])
        exact = next((r["id"] for r in originals if content_hash is not None and r["hash"] == content_hash), None)
        near = min(((bits(simhash, r["fp"]), r["id"]) for r in originals if simhash is not None and r["fp"] is not None), default=(99, None))
        outcome = ("duplicate", exact, None) if exact else ("near_duplicate", near[1], near[0]) if near[0] <= self.limit else ("new", None, None)
        self.rows[next_id] = {"id": next_id, "ws": ws, "url": url, "title": title, "hash": content_hash, "fp": simhash, "confidence": confidence, "dup": outcome[1]}
        return outcome


def made_up(n, seed, copies=0.3, moves=3):
    """(workspace, content hash, fingerprint) of n texts, many of them copies and near copies."""
    rng = random.Random(seed)
    fps, rows = [rng.getrandbits(63) for _ in range(3)], []
    for i in range(n):
        fp = rng.choice(fps)
        for b in rng.sample(range(63), rng.randint(0, moves)):
            fp ^= 1 << b
        if rng.random() < 0.4:
            fps.append(fp)
        kind = rng.random()
        if rows and kind < copies:
            other = rng.choice(rows)
            # now and then a copy with fewer words, and so without a fingerprint
            rows.append((rng.randint(1, 2), other[1], other[2] if rng.random() < 0.8 else None))
        elif kind < copies + 0.08:
            rows.append((rng.randint(1, 2), None, None))
        else:
            rows.append((rng.randint(1, 2), f"h{i}", fp if rng.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_resolve_against_one_by_one(spark, seed):
    rows = made_up(90, seed, copies=0.2 + 0.1 * (seed % 4))
    df = spark.createDataFrame([(ws, i + 1, h, fp) for i, (ws, h, fp) in enumerate(rows)], NODES)
    store = Sequential()
    want = {i + 1: store.take(ws, None, None, h, fp, 1.0, i + 1) for i, (ws, h, fp) in enumerate(rows)}
    got = {r.id: (r.outcome, r.duplicate_of, r.distance) for r in dedup.resolve(df.repartition(1 + seed % 5)).collect()}
    assert got == want


def test_a_copy_goes_to_the_original_that_is_closest_by_then(spark):
    # 2 is three bits from 1; 3 is four from 1 and one from 2, so it is an original; 4, a copy of 2, is closer to 3
    rows = [(1, 1, "a", 0), (1, 2, "b", 0b111), (1, 3, "c", 0b1111), (1, 4, "b", 0b111)]
    got = {r.id: (r.outcome, r.duplicate_of, r.distance) for r in dedup.resolve(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {1: ("new", None, None), 2: ("near_duplicate", 1, 3), 3: ("new", None, None), 4: ("near_duplicate", 3, 1)}


def test_duplicates_have_no_duplicates(spark):
    rows = [(7, 10, "p", 0b11 << 60), (7, 11, "q", 0b1111 << 60 | 1), (7, 12, "r", 0b1111 << 60 | 0b1110), (8, 13, "p", 0b11 << 60)]
    rows = [(ws, i, h, (fp ^ (1 << 63)) - (1 << 63)) for ws, i, h, fp in rows]
    got = {r.id: (r.outcome, r.duplicate_of) for r in dedup.resolve(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {10: ("new", None), 11: ("near_duplicate", 10), 12: ("new", None), 13: ("new", None)}


def test_near_pairs(spark):
    rows = [(1, 5, None, 0), (1, 6, None, 0), (1, 7, None, 0), (1, 8, None, 0b101), (1, 9, None, 0b11111), (2, 10, None, 0), (1, 11, None, None)]
    df = spark.createDataFrame(rows, NODES)
    assert sorted((r.id, r.earlier, r.distance) for r in dedup.near_pairs(df).collect()) == [(6, 5, 0), (7, 5, 0), (8, 5, 2), (9, 8, 3)]
    with pytest.raises(ValueError, match="up to 3"):
        dedup.near_pairs(df, 4)


def test_joins_keep_plain_exchanges(spark):
    df = spark.createDataFrame([(1, 1, "a", 0)], NODES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.exact_originals(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :].splitlines()
    assert [x.split("(")[0].split()[-1] for x in join if "Exchange hashpartitioning(content_hash" in x and "_mark" in x] == ["hashpartitioning"] * 2


# the store


def body(seed, change=0):
    """A text of 80 words; changes of one word keep it near."""
    words = [f"s{seed}w{i % 70}" for i in range(300)]
    for k in range(change):
        words[37 * (k + 1)] = f"changed{seed}x{k}"
    return " ".join(words)


def one_by_one(prints, arrivals):
    """Outcomes and store by Sequential, with the engine's own fingerprints."""
    store, out = Sequential(), {}
    for k, (ws, arrival, url, title, _, confidence) in enumerate(sorted(arrivals, key=lambda a: a[1])):
        h, fp = prints[arrival]
        next_id = len(store.rows) + 1
        out[arrival] = store.take(ws, url, title, h, fp, confidence, next_id)
    return out, store


def story(seed, n=60):
    rng = random.Random(seed)
    arrivals = []
    for i in range(n):
        url = f"https://{rng.randint(0, 25)}.example/" if rng.random() < 0.93 else None
        text = body(rng.randint(0, 3), rng.randint(0, 3)) if rng.random() < 0.85 else rng.choice(["", "few words only", None])
        arrivals.append((rng.randint(1, 2), 10 + 3 * i, url, rng.choice(["T", "U", None]), text, rng.choice([0.5, 0.55, 0.9])))
    return arrivals


@pytest.mark.parametrize(("seed", "cuts"), [(1, []), (2, [20, 40]), (3, [5, 6, 50]), (4, [30]), (5, [])])
def test_upsert_against_one_by_one(spark, seed, cuts):
    arrivals = story(seed)
    marked = dedup.fingerprinted(spark.createDataFrame(arrivals, ARRIVALS)).collect()
    want, sequential = one_by_one({r.arrival: (r.content_hash, r.simhash) for r in marked}, arrivals)
    store, got = spark.createDataFrame([], STORE), {}
    for part in [arrivals[a:b] for a, b in zip([0, *cuts], [*cuts, len(arrivals)], strict=True)]:
        store, said = dedup.upsert(store, spark.createDataFrame(part, ARRIVALS).repartition(3))
        got |= {r.arrival: (r.outcome, r.duplicate_of, r.distance) for r in said.collect()}
        store = spark.createDataFrame(store.collect(), STORE)
    assert got == want
    shown = {r.id: (r.workspace_id, r.canonical_url, r.title, r.content_hash, r.simhash, r.confidence, r.duplicate_of) for r in store.collect()}
    assert shown == {i: (r["ws"], r["url"], r["title"], r["hash"], r["fp"], r["confidence"], r["dup"]) for i, r in sequential.rows.items()}
    assert len({o for o, _, _ in want.values()}) == 5


def test_an_update_that_comes_near_another_stays_an_original(spark):
    kind = "workspace_id long, id long, canonical_url string, title string, body string, confidence double, content_hash string, simhash long, duplicate_of long"
    stored = spark.createDataFrame([(1, 1, "u1", "t", "x", 0.9, "h1", 0b110000, None), (1, 2, "u2", "t", "y", 0.9, "h2", 0b110011, None)], kind)
    arriving = spark.createDataFrame([(1, 5, 0b110000 ^ 0b1111, "h5")], "workspace_id long, id long, simhash long, content_hash string")
    nodes = arriving.withColumn("at", F.lit(5).cast("long"))
    versions = stored.select("workspace_id", "id", "content_hash", "simhash", F.lit(-1).cast("long").alias("since"), F.lit(dedup.NEVER).alias("until"), F.lit(True).alias("settled"))
    assert dedup._decided(nodes, versions, 3).first().best.asDict() == {"rank": 2, "earlier": 2}


def test_arrivals_without_a_url_stand_alone(spark):
    rows = [(1, 1, None, "a", body(1), 0.9), (1, 2, None, "b", body(2), 0.9), (1, 3, None, "a", body(1), 0.9)]
    store, said = dedup.upsert(spark.createDataFrame([], STORE), spark.createDataFrame(rows, ARRIVALS))
    assert sorted((r.id, r.title, r.duplicate_of) for r in store.collect()) == [(1, "a", None), (2, "b", None), (3, "a", 1)]
    assert [r.outcome for r in said.orderBy("arrival").collect()] == ["new", "new", "duplicate"]


def test_ids_follow_arrival(spark):
    rows = [(1, 40 - 3 * i, f"https://{i}.example/", None, f"own text {i}", 0.5) for i in range(6)]
    store, said = dedup.upsert(spark.createDataFrame([(1, 100, "old", "t", "b", 0.5, None, None, None)], STORE), spark.createDataFrame(rows, ARRIVALS))
    assert {r.canonical_url: r.id for r in store.collect()} == {"old": 100} | {f"https://{i}.example/": 106 - i for i in range(6)}
    assert said.filter("outcome = 'new'").count() == 6
    none, nothing = dedup.upsert(spark.createDataFrame([], STORE), spark.createDataFrame([], ARRIVALS))
    assert none.count() == nothing.count() == 0


def test_compatibility_forms_are_equal(spark):
    rows = [(1, 1, "u", "t", "ﬁne ① Ｗords é", 0.5), (1, 2, "v", "t", "FINE 1 words é!", 0.5)]
    _, said = dedup.upsert(spark.createDataFrame([], STORE), spark.createDataFrame(rows, ARRIVALS))
    assert [r.outcome for r in said.orderBy("arrival").collect()] == ["new", "duplicate"]


def test_exact_originals(spark):
    df = spark.createDataFrame([(3, "x"), (4, None), (9, "x"), (5, "y"), (2, "y"), (6, None)], "id long, content_hash string")
    out = dedup.exact_originals(df)
    assert {r.id: r.duplicate_of for r in out.collect()} == {3: None, 4: None, 9: 3, 5: 2, 2: None, 6: None}
    assert [r.id for r in dedup.duplicates_of(out, 2).collect()] == [5]
