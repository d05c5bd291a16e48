"""Lloyd's k-means by two trees: a cover tree over each block of vectors and, in each round, one over the centroids.

A block of vectors (BLOCK at most) gets its cover tree once; trees are kept as a table, one row a block. In a round the pairs
(vector node, centroid node) that are still open are bounded together: with d between the two centers, every vector of the
node is at least d - R - r and at most d + R + r away from the centroids of the other. Centroid nodes whose lower bound is
over a vector node's least upper bound go; a vector node with one centroid left takes it as a whole, with its stored sums;
pairs of leaves are compared exactly, in whole numbers. The driver sees the sums of k clusters a round and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import stash

DIMS = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3
#: Vectors of one cover tree at most, and of one of its leaves unless they are equal.
BLOCK = 1024
LEAF = 8
#: Scaled components beyond this have squared distances that don't fit in 64 bits.
LARGEST = 1 << 27
#: Bounds are in floating point; what is pruned must be this much farther.
SLACK = 1 + 1e-9


class Tree(NamedTuple):
    """Nodes in the order they were made, each before its children: a center (a row of points), the distance of the farthest
    point of its range lo:hi of ``order``, and the range of its children (empty for a leaf)."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree of integer points (n, dims): children of a node lie within half its scale of their points and farther than that
    from each other; the first one has its parent's center. Levels without a split are left out."""
    n = len(points)
    order = np.arange(n)
    nodes: list[list[float]] = []
    far = squares(points, points[:1]) if n else np.zeros(0, np.int64)
    todo = [(0, 0, n, far)] if n else []  # center, range, squared distances of the range's points from the center
    if n:
        nodes.append([0, 0.0, 0, n, 0, 0])
    at = 0
    while at < len(todo):
        center, lo, hi, far = todo[at]
        most = int(far.max())
        nodes[at][1] = most**0.5
        if hi - lo > leaf and most:
            reach = 4 ** ((most.bit_length() - 1) // 2)  # square of the largest power of two that is at most the radius
            reach = reach // 4 if reach == most else reach
            ids = order[lo:hi].copy()
            nodes[at][4] = len(nodes)
            begin = lo
            while len(ids):
                near = far <= reach
                part = ids[near]
                order[begin : begin + len(part)] = part
                nodes.append([center, 0.0, begin, begin + len(part), 0, 0])
                todo.append((center, begin, begin + len(part), far[near]))
                begin += len(part)
                ids = ids[~near]
                if len(ids):
                    center = int(ids[0])
                    far = squares(points[ids], points[center : center + 1])
            nodes[at][5] = len(nodes)
        todo[at] = (0, 0, 0, order[:0])
        at += 1
    center, radius, lo, hi, first, last = np.array(nodes, float).reshape(-1, 6).T
    return Tree(order, center.astype(np.int64), radius, *(c.astype(np.int64) for c in (lo, hi, first, last)))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and which range each is of."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner], owner


def _children(tree: Tree, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes (a leaf stays itself), and which of the given each comes from."""
    inner = tree.last[node] > tree.first[node]
    return _ranges(np.where(inner, tree.first[node], node), np.where(inner, tree.last[node], node + 1))


def assign(points: np.ndarray, tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, centroid) of disjoint ranges of the tree's order that cover all of it: the nearest centroid, of equally near ones
    the first."""
    other = cover_tree(centroids, 1)
    lo, hi, to = [], [], []
    v = c = np.zeros(1 if len(points) else 0, np.int64)
    while len(v):
        apart = np.sqrt(squares(points[tree.center[v]], centroids[other.center[c]]).astype(float))
        reach = tree.radius[v] + other.radius[c]
        begins = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        least = np.minimum.reduceat(apart + reach, begins)
        keep = apart - reach <= np.repeat(least, np.diff(np.append(begins, len(v)))) * SLACK + 1e-6
        v, c = v[keep], c[keep]
        begins = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(v))))
        alone = np.bincount(group)[group] == 1
        lone_centroid = other.hi[c] - other.lo[c] == 1
        done = alone & lone_centroid
        lo.append(tree.lo[v[done]])
        hi.append(tree.hi[v[done]])
        to.append(other.center[c[done]])
        v_leaf = tree.last[v] == tree.first[v]
        c_leaf = other.last[c] == other.first[c]
        # all pairs of a vector node are ready together, or go on together
        ready = v_leaf & (np.bincount(group, ~c_leaf)[group] == 0) & ~done
        if ready.any():
            # leaves of equal centroids hold several of them
            member, of = _ranges(other.lo[c[ready]], other.hi[c[ready]])
            at, pair = _ranges(tree.lo[v[ready]][of], tree.hi[v[ready]][of])
            number = other.order[member][pair]
            d = squares(points[tree.order[at]], centroids[number])
            best = np.lexsort((number, d, at))
            best = best[np.concatenate([[True], at[best][1:] != at[best][:-1]])]
            lo.append(at[best])
            hi.append(at[best] + 1)
            to.append(number[best])
        going = ~done & ~ready
        v, c = v[going], c[going]
        v, from_pair = _children(tree, v)
        c, again = _children(other, c[from_pair])
        v = v[again]
        sort = np.lexsort((c, v))
        v, c = v[sort], c[sort]
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    return join(lo), join(hi), join(to)


def _pack(tree: Tree) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in tree]


_KINDS = (np.int64, np.int64, np.float64, np.int64, np.int64, np.int64, np.int64)
_TREE = ", ".join(f"{name} binary" for name in Tree._fields)


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    """(vec_ids, points, tree) of each row of a table of trees."""
    for i in range(batch.num_rows):
        points = np.frombuffer(batch.column("points")[i].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
        tree = Tree(*(np.frombuffer(batch.column(name)[i].as_py(), kind) for name, kind in zip(Tree._fields, _KINDS, strict=True)))
        yield batch.column("vec_ids")[i].values, points, tree


def usable(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors with exactly ``dims`` components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return vectors.filter((F.size("embedding") == dims) & F.forall(x, fine)).select(F.col("vec_id").cast("long"), x.alias("embedding"))


def _in_reach(scale: int) -> Column:
    """No component is beyond LARGEST."""
    return F.forall("embedding", lambda c: (c * float(scale) < float(LARGEST + 1)) & (c * float(scale) >= float(-LARGEST)))


def trees(kept: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row for each block of vectors: their ids, scaled whole components and cover tree. Vectors with a component beyond LARGEST
    are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                points = np.floor(part.column("embedding").flatten().to_numpy().reshape(-1, dims) * scale).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), part.column("vec_id"))
                rest = [points.astype(np.int32).tobytes(), *_pack(cover_tree(points))]
                yield pa.RecordBatch.from_arrays([lists, *(pa.array([b], pa.binary()) for b in rest)], ["vec_ids", "points", *Tree._fields])

    return stash(kept.filter(_in_reach(scale)).mapInArrow(run, f"vec_ids array<long>, points binary, {_TREE}"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order; of equal ids, the smaller vector first."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter(F.col("vec_id").isNotNull() & _in_reach(scale)).select(mark.alias("mark"), "embedding").orderBy("mark", "embedding").limit(k).collect()
    return np.floor(np.array([r["embedding"] for r in rows], float).reshape(-1, dims) * scale).astype(np.int64)


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Vectors and componentwise sums of each centroid's cluster."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, points, tree in _blocks(batch, dims):
                lo, hi, to = assign(points, tree, centroids)
                upto = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(points[tree.order], 0)])
                np.add.at(sums, to, upto[hi] - upto[lo])
                np.add.at(counts, to, hi - lo)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * dims), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), lists], ["cluster", "n", "sums"])

    parts = blocks.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    n, total = [0] * k, [[0] * dims for _ in range(k)]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        n[r["cluster"]], total[r["cluster"]][r["place"]] = int(r["n"]), int(r["total"])
    return n, total


def members(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector: its nearest centroid and the squared distance."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, tree in _blocks(batch, dims):
                lo, hi, to = assign(points, tree, centroids)
                at, owner = _ranges(lo, hi)
                cluster = np.empty(len(points), np.int64)
                cluster[tree.order[at]] = to[owner]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(squares(points, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector of (vec_id, embedding).

    Components become floor(scale * x). The first centroids are first_centroids(); a round assigns each vector to the nearest
    centroid (squared Euclidean distance; of equally near ones, the smaller number) and then moves each centroid to the
    componentwise floor of its vectors' mean; one without vectors stays. After the rounds vectors are assigned once more.

    Null vectors, and those with another number of components or a null or non-finite one, give no row. A vector with a
    component beyond LARGEST gives a row with nulls, belongs to no cluster and counts in no sum, as its distance doesn't fit in
    64 bits; sums that don't fit are null too. Repeated rows count each; a null vec_id is kept but never a first centroid.
    With fewer than k vectors there are as many centroids; without any, all rows have nulls. Other columns are ignored.
    """
    kept = usable(vectors, dims)
    centroids = first_centroids(kept, k, seed, dims, scale)
    blocks = trees(kept, dims, scale)
    if len(centroids):
        for _ in range(rounds):
            n, total = cluster_sums(blocks, centroids)
            moved = [[s // n[j] for s in total[j]] if n[j] else centroids[j].tolist() for j in range(len(centroids))]
            if moved == centroids.tolist():
                break  # all later rounds would be the same
            centroids = np.array(moved, np.int64)
        found = stash(members(blocks, centroids))
    else:
        found = blocks.select(F.explode("vec_ids").alias("vec_id"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    # one row a cluster
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = lambda x: None if x is None or x >= 1 << 63 else int(x)
    of = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster")) if values else F.lit(None).cast(kind)
    found = found.select(
        "vec_id",
        "cluster",
        "distance",
        of([whole(sums.get(j)) for j in range(len(digest))], "long").alias("cluster_inertia"),
        F.lit(whole(sum(filter(None, sums.values())))).cast("long").alias("inertia"),
        of(digest, "string").alias("centroid_sha256"),
    )
    too_large = kept.filter(~_in_reach(scale))
    return found.unionByName(too_large.select("vec_id"), allowMissingColumns=True)
