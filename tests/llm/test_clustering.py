import hashlib
import math

import numpy as np
import pytest

from newsloom.llm import clustering

SHAPE = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k=8, rounds=10, seed=3, dims=64):
    """Plain Lloyd over (vec_id, embedding) rows; a list of (vec_id, cluster, distance) and the centroids."""
    kept = [(i, tuple(math.floor(1024 * c) for c in x)) for i, x in rows if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)]
    kept = [(i, x) for i, x in kept if max(map(abs, x)) <= clustering.LARGEST]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centroids = [x for _, x in starts]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centroids = [tuple(sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)) if j in groups else c for j, c in enumerate(centroids)]
    return [(i, *reversed(nearest(x))) for i, x in kept], centroids


@pytest.mark.parametrize("seed", range(8))
def test_assign_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    dims, spread = [(2, 5), (3, 40), (64, 300), (8, 2)][seed % 4]
    points = rng.integers(-spread, spread, (700, dims)) + rng.integers(-4, 5, (1, dims)) * rng.integers(0, 60, (700, 1))
    points[rng.integers(0, 700, 200)] = points[3]
    centroids = points[rng.integers(0, 700, [1, 8, 30][seed % 3])]
    tree = clustering.cover_tree(points)
    lo, hi, to = clustering.assign(points, tree, centroids)
    got = np.full(700, -1)
    for a, b, j in zip(lo, hi, to, strict=True):
        assert (got[tree.order[a:b]] == -1).all()
        got[tree.order[a:b]] = j
    d = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert (got == d.argmin(1)).all()  # the first of equal ones


def test_bounds_save_comparisons(monkeypatch):
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 6, (1000, 1)) * 5000 + rng.integers(0, 300, (1000, 16))).astype(np.int64)
    centroids = np.arange(6)[:, None] * 5000 + np.full((6, 16), 150)
    tree, seen = clustering.cover_tree(points), [0]
    plain = clustering.squares
    monkeypatch.setattr(clustering, "squares", lambda a, b: seen.__setitem__(0, seen[0] + len(a)) or plain(a, b))
    clustering.assign(points, tree, centroids)
    assert seen[0] < 1000  # of 6,000 pairs


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-50, 50, (300, [1, 2, 5, 64][seed]))
    points[:90] = points[0]
    tree = clustering.cover_tree(points)
    assert sorted(tree.order) == list(range(300))
    for v in range(len(tree.center)):
        inside = tree.order[tree.lo[v] : tree.hi[v]]
        far = np.sqrt(((points[inside] - points[tree.center[v]]) ** 2).sum(1))
        assert np.isclose(far.max(), tree.radius[v]) and tree.center[v] in inside
        kids = range(tree.first[v], tree.last[v])
        if kids:
            assert [tree.lo[v], *(tree.hi[c] for c in kids)] == [*(tree.lo[c] for c in kids), tree.hi[v]]
            reach = max(tree.radius[c] for c in kids)
            assert tree.center[kids[0]] == tree.center[v] and reach < tree.radius[v]
            centers = points[[tree.center[c] for c in kids]]
            gaps = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))[np.triu_indices(len(centers), 1)]
            assert (gaps > reach).all()
        else:
            assert len(inside) <= clustering.LEAF or tree.radius[v] == 0


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(i, (rng.normal(0, 0.1, 64) + (i % 10) * 0.05).tolist()) for i in range(400)]
    hot = out[7][1]
    out += [(1000 + i, hot) for i in range(300)]
    odd = [(2000, None), (2001, []), (2002, hot[:63]), (2003, [*hot, 0.1]), (2004, [None, *hot[1:]]), (2005, [math.nan, *hot[1:]]), (2006, [math.inf, *hot[1:]])]
    return [*out, *odd, (3, out[3][1]), (3, out[4][1]), (None, out[5][1]), (2007, [1e300, *hot[1:]]), (2008, [-131072.0, *hot[1:]])]


@pytest.mark.parametrize("block", [1024, 37])
def test_cluster(spark, monkeypatch, rows, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    df = spark.createDataFrame([(i, x, "other") for i, x in rows], SHAPE).repartition(3)
    got = clustering.cluster(df).collect()
    want, centroids = brute(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    fit = [r for r in got if r.cluster is not None]
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in fit), key=key) == sorted(want, key=key)
    assert [(r.vec_id, r.distance, r.centroid_sha256, r.cluster_inertia) for r in got if r.cluster is None] == [(2007, None, None, None)]
    for r in fit:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_and_none(spark, rows):
    df = spark.createDataFrame([(i, x, "") for i, x in rows[:5]], SHAPE)
    got = sorted((r.vec_id, r.cluster, r.distance) for r in clustering.cluster(df).collect())
    assert got == sorted(brute(rows[:5])[0]) and {d for *_, d in got} == {0}
    assert clustering.cluster(df.filter("false")).count() == 0
    only_null_ids = df.withColumn("vec_id", df.vec_id * None)
    assert [(r.cluster, r.distance) for r in clustering.cluster(only_null_ids).collect()] == [(None, None)] * 5
