"""SimHash near-duplicates found with Golay-code keys.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits. Each segment, padded to 23 bits, is decoded in
the perfect binary Golay code [23, 12, 7]: the indices (12 bits) of all codewords within distance 4, which are one or six.
Two segments within distance 2 have a word halfway between them whose codeword lies within distance 4 of both, so they
share an index. Up to four differing bits fall on the three segments in one of two ways (pigeonhole):

* one segment is equal and another differs in at most two bits: key = exact segment + an index of the other;
* every segment differs in at most two bits: key = an index of each.

Pairs that share a key are verified by counting bits. Exact copies are one fingerprint before any key is made.

near_texts() links texts by the similarity of their shingles instead: fingerprints within four bits are candidates, and as such
bits reach only a part of the pairs at 0.8, MinHash keys give the others (see shingles); whole shingle sets decide on all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import shingles
from newsloom.llm.components import components, neighbours
from newsloom.llm.kernels import blocks
from newsloom.session import cut, plain_join

BITS = 64
MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one key that are compared with each other; larger sets are linked through halfway words instead.
BUCKET = 256
_U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles (repeats included); no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], _U)
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of each row of docs (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                fp = np.array([fingerprint(t, shingle) for t in texts], _U)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a 23-bit word, and for each syndrome the error patterns of weight four or
    less, six places each; -1 is an unused place."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    of_bit = [remainder(1 << b) for b in range(23)]

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int32)
        for i, s in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ s
        return out

    errors = np.full((2048, 6), -1, np.int32)
    used = np.zeros(2048, int)
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for p in places:
                s ^= of_bit[p]
            errors[s, used[s]] = sum(1 << p for p in places)
            used[s] += 1
    return table(of_bit[:12]), table(of_bit[12:]), errors


def indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of each 23-bit word; -1 where there are fewer."""
    low, high, errors = golay()
    e = errors[low[segment & 4095] ^ high[segment >> 12]]
    return np.where(e < 0, -1, (segment[:, None] ^ e) >> 11)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (unsigned), and the place in fp that each belongs to."""
    parts = [((fp >> _U(at)) & _U((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [indices(p).astype(np.int64) for p in parts]
    out, owner = [], []

    def add(tag: int, key: np.ndarray, good: np.ndarray) -> None:
        out.append((key | tag << 40)[good])
        owner.append(np.nonzero(good)[0])

    for i in range(3):
        for j in range(3):
            if i != j:
                add(3 * i + j, parts[i][:, None] << 12 | near[j], near[j] >= 0)
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    add(9, a << 24 | b << 12 | c, (a >= 0) & (b >= 0) & (c >= 0))
    return np.concatenate(out), np.concatenate(owner)


def _canonical(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The one key, of those that two fingerprints within MAX_BITS share, under which they are linked."""
    part = lambda x, i: ((x >> _U(SEGMENTS[i][0])) & _U((1 << SEGMENTS[i][1]) - 1)).astype(np.int64)
    apart = [np.bitwise_count(part(u ^ v, i)) for i in range(3)]
    common = []
    for i in range(3):
        a, b = indices(part(u, i)), indices(part(v, i))
        same = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
        common.append(np.where(same, a[:, :, None], 1 << 12).min((1, 2)).astype(np.int64))
    out = 9 << 40 | common[0] << 24 | common[1] << 12 | common[2]
    for i in reversed(range(3)):
        for j in reversed(range(3)):
            if i != j:
                out = np.where((apart[i] == 0) & (apart[j] <= 2), 3 * i + j << 40 | part(u, i) << 12 | common[j], out)
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of n nodes to the least of its component under the pairs (a, b), other than itself."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 1024):
            part = fps[i : i + 1024]
            key, owner = keys(part.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[owner])], ["key", "fp"])


def _halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word within distance 2 of each fingerprint: two fingerprints share one if and only if they differ in at most four bits."""
    flips = np.array([0, *(1 << i for i in range(BITS)), *(1 << i | 1 << j for i, j in combinations(range(BITS), 2))], _U)
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 128):
            part = fps[i : i + 128]
            key = (part.view(_U)[:, None] ^ flips[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(part, len(flips)))], ["key", "fp"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Keys and fingerprints of a stream sorted by key, cut between keys where that needs no more than a bucket's rows of
    memory; True if the piece is a run of one over-full key."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = None  # the key whose set was too large for a bucket, while its rows still come
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy()])
        if not len(key):
            continue
        if full is not None:
            n = int(np.searchsorted(key, full, "right"))
            yield key[:n], fp[:n], True
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            full = None
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield key[:last], fp[:last], False
            key, fp = key[last:], fp[last:]
        if len(key) > BUCKET:
            full = key[0]
            yield key, fp, True
            key, fp = key[:0], fp[:0]
    if len(key):
        yield key, fp, False


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links under one key, at most one for each of its fingerprints, whose components are those of its verified pairs; a
    pair is looked at under its canonical key alone. Fingerprints of over-full keys come back as (fp, null)."""
    for key, fp, over in _sorted_groups(batches):
        if over:
            u, v = fp, None
        else:
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([begins, [len(key)]]))
            group = np.repeat(size, size)
            big = group > BUCKET
            if big.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[big]), pa.nulls(int(big.sum()), pa.int64())], ["u", "v"])
            key, fp = key[~big], fp[~big]
            alive = np.arange(len(key))
            firsts, seconds = [], []
            for step in range(1, BUCKET):
                alive = alive[alive + step < len(key)]
                alive = alive[key[alive] == key[alive + step]]
                if not len(alive):
                    break
                near = alive[np.bitwise_count((fp[alive] ^ fp[alive + step]).view(_U)) <= MAX_BITS]
                near = near[_canonical(fp[near].view(_U), fp[near + step].view(_U)) == key[near]]
                firsts.append(near)
                seconds.append(near + step)
            if not firsts:
                continue
            moved, to = _forest(len(key), np.concatenate(firsts), np.concatenate(seconds))
            u, v = fp[moved], fp[to]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v)], ["u", "v"])


def links(fps: DataFrame, crowded_too: bool = True) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within MAX_BITS of the distinct fingerprints fps (fp); without
    ``crowded_too``, of those under keys with no more than BUCKET fingerprints.

    A key with over BUCKET fingerprints is not compared pair by pair: its fingerprints are linked through the words halfway,
    exactly and in proportion to their number, at 2,081 rows each. One task reads the fingerprints of a key, as a stream, of
    which it holds BUCKET and a batch.
    """
    shape = "key long, fp long"
    # each fingerprint makes some two hundred rows, so they are spread before, not after
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(
        fps.repartition(parts, F.xxhash64("fp")).mapInArrow(_keyed, shape).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "u long, v long").distinct()
    )
    direct = found.filter("v is not null")
    if not crowded_too:
        return direct
    crowded = found.filter("v is null").select(F.col("u").alias("fp"))
    halfway = crowded.mapInArrow(_halfway, shape).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(neighbours, "u long, v long")
    return direct.unionByName(halfway.distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable through links of MAX_BITS or fewer differing bits. A null text counts as
    empty; texts without words have fingerprint 0 and are linked like any other. Rows that repeat a doc_id each give a row.
    A null doc_id is kept and never the smallest. An empty table gives no rows. Other columns are ignored.
    """
    marked = cut(fingerprints(docs, shingle))
    per_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    label = components(links(per_fp.select("fp"))).select(F.col("node").alias("fp"), "label")
    # only fingerprints with links have to find their component's head
    grouped = per_fp.join(label, "fp")
    heads = grouped.groupBy("label").agg(F.min("first_doc").alias("head"))
    of_linked = plain_join(grouped, heads, ["label"]).select("fp", "head")
    of_fp = per_fp.join(of_linked, "fp", "left").select("fp", F.coalesce("head", "first_doc").alias("component_id"))
    return plain_join(marked, of_fp, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_texts(docs: DataFrame, shingle: int = shingles.SHINGLE, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """(id, label) of the different texts of docs (text) whose shingle sets have a Jaccard similarity with another's of at least
    ``similarity``: shingles.text_id() of the text, and one that all texts of its component share.

    A null text counts as empty; texts without words are near each other. Copies of a text are one before anything else is
    done with it. Other columns are ignored; an empty table gives no rows.
    """
    marks = cut(_marks(docs, shingle))
    # the first text of a fingerprint stands for it
    of_fp = marks.groupBy("fp").agg(F.min("id").alias("least"))
    # candidates only, which come first: similar texts under crowded keys share MinHash keys as well, and all pairs under those count
    near = links(of_fp.select("fp"), crowded_too=False)
    end = lambda c, name: of_fp.select(F.col("fp").alias(c), F.col("least").alias(name))
    found = near.join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    same = plain_join(marks.select("id", "fp"), of_fp, ["fp"]).filter("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    pairs = cut(found.unionByName(same).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    return shingles.near_groups(docs, marks.select("id", "keys", "sketch"), pairs, shingle, similarity)


def _marks(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, fp, keys, sketch) of each different text of docs (text): its shingles.text_id(), fingerprint, MinHash keys and
    shingles.sketch(). Copies are dropped before they are read, within a partition, and then between partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # ids of one partition
        for batch in batches:
            for part, texts in blocks(batch):
                ids = part.column("id").to_pylist()
                some = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
                if some:
                    once = [texts[i] for i in some]
                    fp = np.array([fingerprint(t, shingle) for t in once], _U)
                    hashes = shingles.shingle_hashes(once, shingle)
                    keys = shingles.band_keys(hashes)
                    flat = pa.array(np.ascontiguousarray(keys).ravel().view(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * shingles.BANDS), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array(fp.view(np.int64)), lists, pa.array([shingles.sketch(h) for h in hashes], pa.binary())], ["id", "fp", "keys", "sketch"])

    read = docs.select(shingles.text_id().alias("id"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(run, "id long, fp long, keys array<long>, sketch binary").groupBy("id").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))


def _row_id(docs: DataFrame) -> Column:
    """64-bit hash of all columns of a row."""
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def heads(docs: DataFrame, shingle: int = shingles.SHINGLE, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """(row, doc_id, n) of one row of docs (doc_id, text) for each component of near_texts(): that with the smallest doc_id; a null
    one comes last, and of rows with one doc_id the one with the smallest hash is taken. row is the hash of all its columns, n
    the number of rows alike."""
    per_row = docs.select(shingles.text_id().alias("id"), "doc_id", _row_id(docs).alias("row")).groupBy("row").agg(F.first("id").alias("id"), F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"), F.col("n").alias("n")))
    per_text = per_row.groupBy("id").agg(first.alias("first"))
    of_component = per_text.join(near_texts(docs, shingle, similarity), "id", "left").groupBy(F.coalesce("label", "id")).agg(F.min("first").alias("first"))
    return cut(of_component.select("first.row", "first.doc_id", "first.n"))


def keep_one(docs: DataFrame, shingle: int = shingles.SHINGLE, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """One row of docs for each component of near-duplicates, by heads(). Rows alike in all columns are one."""
    found = heads(docs, shingle, similarity)
    rows = docs.withColumn("row", _row_id(docs))
    alone = rows.join(found.filter("n = 1").select("row"), "row", "left_semi")
    # only rows that are repeated as a whole have to meet
    repeated = plain_join(rows, found.filter("n > 1").select("row"), ["row"], "left_semi").groupBy("row").agg(*(F.first(c).alias(c) for c in docs.columns))
    return alone.unionByName(repeated).drop("row")
