"""Decisions on near-duplicates by whole sets of word shingles, and MinHash keys that find candidates.

Two texts are linked if the sets of their shingles (five words in lower case; a shorter text is one shingle) have a Jaccard
similarity of 0.8 or more. Each text has 40 keys, each of six MinHash values: of the pairs at 0.8 exactly, five in a million
are expected to share no key, of more similar ones fewer.

Pairs that share keys are far more than are needed to tell components. Under each key texts are put in the order of their next
two keys, so that those that share more of them stand side by side, and neighbours are compared: a text has two neighbours
under each of its keys at most, however many share it. First each text meets the neighbour that it has most often, then the
others that aren't in its component yet, and then texts of other components up to WIDE places off. Keys whose texts are in
several components even then are compared whole: every pair of different components, in cells of CELL texts by CELL. A bound
on the similarity from sketches of the sets rules out nearly all of these without reading them, and never one that is similar
enough: each shingle falls on one of SKETCH bits, a bit tells if an odd number does, and two sets differ by as many shingles
as their bits do at least. Sets meet in joins by pairs, so no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.components import components
from newsloom.llm.kernels import Words, blocks, grams, mix, signed
from newsloom.session import cut, plain_join, stash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
#: How far apart texts of different components are compared under a key before keys are compared whole.
WIDE = 4
#: Bits of a set's sketch, and texts under a key that meet as many others in one cell, about.
SKETCH, CELL = 1024, 2048
_U = np.uint64
_rng = np.random.default_rng(7)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_JOIN = _rng.integers(0, 1 << 63, ROWS, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def text_id(text: Column | str = "text") -> Column:
    """64-bit hash of a text; a null one is empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def shingle_hashes(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the shingles of each text, repeats included; no words, none."""
    words = Words([t.lower() for t in texts])
    h = words.hashes()
    return [grams(h[a : a + n], min(shingle, n)) if n else h[:0] for a, n in zip(words.first[:-1].tolist(), words.n.tolist(), strict=True)]


def band_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS) keys of texts with these shingle hashes."""
    some = np.flatnonzero([len(h) > 0 for h in hashes])
    low = np.full((BANDS * ROWS, len(hashes)), 0xFFFFFFFF, np.uint32)
    if len(some):
        flat = (np.concatenate([hashes[i] for i in some]) >> _U(32)).astype(np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(hashes[i]) for i in some])[:-1]])
        for j in range(BANDS * ROWS):
            low[j, some] = np.minimum.reduceat(flat * _TIMES[j] + _PLUS[j], begin)
    joined = (low.reshape(BANDS, ROWS, -1).astype(_U) * _JOIN[None, :, None]).sum(1, dtype=_U)
    return mix(joined + np.arange(BANDS, dtype=_U)[:, None]).T


def sketch(hashes: np.ndarray) -> bytes:
    """The number of different hashes, and for each of SKETCH bits whether an odd number of them falls on it."""
    once = np.unique(hashes)
    odd = np.bincount((once >> _U(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.uint64(len(once)).tobytes() + np.packbits(odd.astype(bool)).tobytes()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream (key, id) sorted by key: rows whose key has several ids, with the id before (null for the first). A row is held back
    until the next one tells whether it is alone."""
    key = ids = np.zeros(0, np.int64)
    before = -1  # the id before the held row, under its key
    with_before = False
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        ids = np.concatenate([ids, batch.column("id").to_numpy()])
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]) if len(key) else np.zeros(0, bool)
        key, ids = key[new], ids[new]
        if len(key) < 2:
            continue
        same = key[1:] == key[:-1]
        after, prior = same, np.concatenate([[with_before], same[:-1]])
        prior_id = np.concatenate([[before], ids[:-2]])
        keep = after | prior
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(ids[:-1][keep]), pa.array(prior_id[keep], mask=~prior[keep])], ["key", "id", "before"])
        before, with_before = int(ids[-2]), bool(same[-1])
        key, ids = key[-1:], ids[-1:]
    if len(key) and with_before:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array([before], pa.int64())], ["key", "id", "before"])


def shared_keys(marks: DataFrame) -> DataFrame:
    """(key, id, before) of the keys that several texts share, from marks (id, keys): before is the text next to it under the key, in the
    order of the two keys that follow."""
    after = lambda k: F.get("keys", (F.col("band") + k) % BANDS)
    rows = marks.select("id", "keys", F.posexplode("keys").alias("band", "key")).select("key", after(1).alias("second"), after(2).alias("third"), "id")
    order = ["key", "second", "third", "id"]
    return cut(rows.repartition("key").sortWithinPartitions(*order).select("key", "id").mapInArrow(_shared, "key long, id long, before long"))


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream (key, id, label) sorted by key: pairs (u, v) of different labels that stand at most WIDE apart under a key, and
    (key, n) of the keys with pairs farther apart, which have n texts of several labels."""

    def told(u: np.ndarray, v: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [(u, len(key)), (v, len(key)), (key, -len(u)), (n, -len(u))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(max(-k, 0), pa.int64()), pa.array(x, pa.int64()), pa.nulls(max(k, 0), pa.int64())]) for x, k in columns], ["u", "v", "key", "n"])

    none = np.zeros(0, np.int64)
    key = ids = label = none
    state: list[int] = []  # key, rows, least and greatest label of the last key so far
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = len(key)
        key, ids, label = (np.concatenate([a, batch.column(c).to_numpy()]) for a, c in ((key, "key"), (ids, "id"), (label, "label")))
        for step in range(1, WIDE + 1):
            at = np.arange(max(fresh - step, 0), max(len(key) - step, 0))
            at = at[(at + step >= fresh) & (key[at] == key[at + step]) & (label[at] != label[at + step])]
            if len(at):
                a, b = ids[at], ids[at + step]
                yield told(np.maximum(a, b), np.minimum(a, b), none, none)
        new_key, new_label = key[fresh:], label[fresh:]
        begins = np.flatnonzero(np.concatenate([[True], new_key[1:] != new_key[:-1]]))
        sums = [new_key[begins], np.diff(np.concatenate([begins, [len(new_key)]])), np.minimum.reduceat(new_label, begins), np.maximum.reduceat(new_label, begins)]
        if state and state[0] == sums[0][0]:
            sums[1][0] += state[1]
            sums[2][0], sums[3][0] = min(sums[2][0], state[2]), max(sums[3][0], state[3])
        elif state:
            sums = [np.concatenate([[x], y]) for x, y in zip(state, sums, strict=True)]
        state = [int(x[-1]) for x in sums]
        whole = np.flatnonzero((sums[2] != sums[3]) & (sums[1] > WIDE + 1))
        whole = whole[whole < len(sums[0]) - 1]
        if len(whole):
            yield told(none, none, sums[0][whole], sums[1][whole])
        key, ids, label = key[-WIDE:], ids[-WIDE:], label[-WIDE:]
    if state and state[2] != state[3] and state[1] > WIDE + 1:
        yield told(none, none, np.array(state[:1]), np.array(state[1:2]))


def _in_cells(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a stream (key, i, j, part, id, label, sketch) sorted by key, i and j: the pairs (u, v) of different labels of each cell, one of
    part i and one of part j, that may be that similar by their sketches, with the least number of shingles that they differ by."""
    share = (1 - similarity) / (1 + similarity)  # two sets differ by this share of the sum of their sizes at most

    def pairs(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, label = cell.column("id").to_numpy(), cell.column("label").to_numpy()
        if label.min() == label.max():
            return
        raw = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), _U).reshape(len(ids), -1)
        size, bits = raw[:, 0].astype(np.int64), raw[:, 1:]
        part, i, j = cell.column("part").to_numpy(), cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            apart = np.abs(size[a, None] - size[None, right])
            differ = np.zeros(apart.shape, np.int64)
            for w in range(bits.shape[1]):
                differ += np.bitwise_count(bits[a, w][:, None] ^ bits[right, w][None, :])
            differ = np.maximum(differ, apart)
            good = (differ <= share * (size[a, None] + size[None, right]) + 1e-6) & (label[a, None] != label[None, right])
            if i == j:
                good &= ids[a, None] < ids[None, right]
            x, y = np.nonzero(good)
            if len(x):
                u, v = ids[a[x]], ids[right[y]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(differ[x, y])], ["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            cell = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
            ends = [*(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1).tolist()]
            for begin, end in zip([0, *ends[:-1]], ends, strict=True) if ends else ():
                yield from pairs(rows.slice(begin, end - begin))
            held = rows.slice(ends[-1] if ends else 0).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def whole_keys(rows: DataFrame, keys: DataFrame, marks: DataFrame, label: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v, n) of all pairs with different labels under the given keys (key, n) that the sketches of marks (id, sketch) don't rule out;
    rows (key, id) has the texts of each key, label (node, label) those of linked texts. n: they differ by so many shingles at
    least. Texts of a key with n of them are dealt out to n / CELL parts, and each part meets each in a cell."""
    known = plain_join(rows.select("key", "id").join(keys, "key"), label.select(F.col("node").alias("id"), "label"), ["id"], "left")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    dealt = known.select("key", "id", F.coalesce("label", "id").alias("label"), parts.alias("parts"), F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("part"))
    sketched = plain_join(dealt, marks.select("id", "sketch"), ["id"])
    other = sketched.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = other.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "label", "sketch")
    found = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_in_cells(similarity), "u long, v long, n long")
    return found.distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets (sorted, no repeats); two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similar(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) of ids whose texts are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                u, v = part.column("u").to_numpy(), part.column("v").to_numpy()
                sets: dict[int, np.ndarray] = {}
                for ids, column in ((u, "a"), (v, "b")):
                    # neighbouring rows share texts
                    once, at = np.unique(ids, return_index=True)
                    for piece, raw in blocks(pa.RecordBatch.from_arrays([pa.array(once), part.column(column).take(pa.array(at))], ["id", "text"])):
                        sets |= {k: np.unique(h) for k, h in zip(piece.column("id").to_pylist(), shingle_hashes(raw, shingle), strict=True)}
                good = np.array([jaccard(sets[x], sets[y]) >= similarity for x, y in zip(u.tolist(), v.tolist(), strict=True)], bool)
                yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], ["u", "v"])

    text = lambda key, name: texts.select(F.col("id").alias(key), F.col("text").cast("binary").alias(name))
    return plain_join(plain_join(pairs.select("u", "v"), text("u", "a"), ["u"]), text("v", "b"), ["v"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs that aren't in one component yet."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    known = plain_join(plain_join(pairs, of("u"), ["u"], "left"), of("v"), ["v"], "left")
    return known.filter(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select(*pairs.columns)


def near_groups(docs: DataFrame, marks: DataFrame, candidates: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, label) of the texts of docs that are similar to others: label is the least id of the component. marks (id, keys, sketch)
    has the keys and the sketch of each text; compared are candidates (u, v with u > v) and all that share keys, unless they are in
    one component already or their sketches rule them out."""
    rows = shared_keys(marks)
    chained = rows.filter("before is not null").groupBy(F.greatest("id", "before").alias("u"), F.least("id", "before").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    tried = cut(chained.unionByName(candidates.distinct().withColumn("n", F.lit(BANDS).cast("long"))).groupBy("u", "v").agg(F.sum("n").alias("n")))
    # texts are needed only of these, each once; copies are dropped before the exchange
    needed = rows.select("id").unionByName(candidates.select(F.explode(F.array("u", "v")).alias("id"))).distinct()
    texts = docs.select(text_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = stash(plain_join(texts, needed, ["id"], "left_semi").groupBy("id").agg(F.first("text").alias("text")))
    nearest = cut(tried.groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v")))
    links = cut(similar(nearest, texts, shingle, similarity))
    rest = _apart(tried.select("u", "v").join(nearest, ["u", "v"], "left_anti"), components(links))
    links = links.unionByName(cut(similar(rest, texts, shingle, similarity)))
    label = cut(components(links))
    # texts that are in different components, near each other under a key
    labelled = plain_join(rows.select("key", "id"), label.select(F.col("node").alias("id"), "label"), ["id"], "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    crossing = cut(labelled.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_crossing, "u long, v long, key long, n long"))
    tried = tried.select("u", "v")
    fresh = cut(crossing.filter("key is null").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"))
    links = links.unionByName(cut(similar(fresh, texts, shingle, similarity)))
    keys = crossing.filter("key is not null").select("key", "n")
    if not keys.isEmpty():
        label = cut(components(links))
        tried = tried.unionByName(fresh)
        last = cut(whole_keys(rows, keys, marks, label, similarity).join(tried, ["u", "v"], "left_anti"))
        # the likeliest of each text first: many others are in its component then
        nearest = cut(last.groupBy("u").agg(F.min_by("v", F.struct("n", "v")).alias("v")))
        links = links.unionByName(cut(similar(nearest, texts, shingle, similarity)))
        rest = _apart(last.select("u", "v").join(nearest, ["u", "v"], "left_anti"), components(links))
        links = links.unionByName(cut(similar(rest, texts, shingle, similarity)))
    return components(links).select(F.col("node").alias("id"), "label")
