"""Packing of tokenised documents into fixed-length sequences by repeated length patterns.

Only lengths matter: their histogram has at most CAPACITY entries, however many documents there are. Patterns of two to
four lengths that fill a sequence exactly are enumerated, non-negative least squares fits how often each is repeated, the
counts are rounded down within what the histogram has, and what is left is packed best-fit, longest first, again on the
histogram. Documents then take their places by their rank among those of equal length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.kernels import blocks
from newsloom.session import cut

CAPACITY = 2048
END_ID = 0
#: Lengths that are tried as the second and third of a pattern, for each first length.
PARTNERS = 16
SWEEPS = 30
#: At most about so many documents of equal length are ranked in one group, and fewer if that is over a task's share of all.
RANKED = 1 << 18

#: Where the two tokenizer libraries below might cut words differently; such texts take the slower one.
_UNSURE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧]|<\|endoftext\|>")


@cache
def _full(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _quick(ranks_path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_paths() -> tuple[str, str]:
    """The default vocabulary, in the formats of the two libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str, paths: tuple[str, str]) -> list[int]:
    """Token ids of a text. Both libraries hold one vocabulary and give equal ids; the quick one is used where that is certain."""
    return _full(paths[0]).encode(text, add_special_tokens=False).ids if _UNSURE.search(text) else _quick(paths[1]).encode_ordinary(text)


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first, which takes what is over."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's pieces; a null text has just the end id.

    Whole texts are tokenised. Rows stand alone: repeated rows and null ids give pieces like any other, other columns are
    ignored, an empty table gives none.
    """
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(texts):
                    ids = np.array([*encode(text.decode("utf-8", "replace"), paths), END_ID], "<u4")
                    rows.extend((i, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut_pieces(len(ids), capacity)))
                at, *columns = np.array(rows, np.int64).reshape(-1, 5).T
                arrays = [part.column("doc_id").take(pa.array(at)), pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, shape)


def patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Exact fills of a sequence by two to four of the lengths that occur, in descending order."""
    have = [int(x) for x in np.flatnonzero(counts)]
    present = set(have)
    found = {(capacity - a, a) if capacity - a >= a else (a, capacity - a) for a in have if capacity - a in present}
    # partners spread evenly over the documents, not over the lengths
    spread = np.cumsum(counts[have])
    tries = sorted({have[int(np.searchsorted(spread, q))] for q in np.linspace(1, spread[-1], PARTNERS)}) if have else []
    for a in have:
        for b in tries:
            c = capacity - a - b
            if c in present:
                found.add(tuple(sorted((a, b, c), reverse=True)))
            for d in tries if c > 0 else ():
                if c - d in present and c - d >= d:
                    found.add(tuple(sorted((a, b, d, c - d), reverse=True)))
    return sorted(found, reverse=True)


def fit(counts: np.ndarray, chosen: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """How often to repeat each pattern: non-negative least squares against the histogram by coordinate descent."""
    rest = counts.astype(float).tolist()
    x = [0.0] * len(chosen)
    columns = [[(length, pattern.count(length)) for length in set(pattern)] for pattern in chosen]
    norms = [sum(k * k for _, k in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(rest[length] * k for length, k in column) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for length, k in column:
                    rest[length] -= step * k
        if moved < 1e-3 * (1 + sum(x)):
            break
    return np.array(x)


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the sequences that best-fit packing makes, longest first, equal sequences taken together."""
    room: list[int] = []  # free places of open sequences, sorted; groups holds them by free places
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(free: int, times: int, lengths: tuple[int, ...]) -> None:
        if free not in groups:
            groups[free] = []
            insort(room, free)
        groups[free].append((times, lengths))

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            i = bisect_left(room, length)
            if i < len(room):
                free = room[i]
                times, lengths = groups[free].pop()
                if not groups[free]:
                    del groups[free], room[i]
                k = min(free // length, n)  # so many fit in each
                use = min(times, n // k)
                if times > use:
                    put(free, times - use, lengths)
                put(free - k * length, use, (*lengths, *[length] * k))
            else:
                k = min(capacity // length, n)
                use = n // k
                put(capacity - k * length, use, (length,) * k)
            n -= use * k
    return [g for free in room for g in groups[free]]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of all sequences for a histogram of lengths (index: length)."""
    left = counts.astype(np.int64).copy()
    out = [(int(left[capacity]), (capacity,))] if left[capacity] else []
    left[capacity] = 0
    chosen = patterns(left, capacity)
    x = fit(left, chosen)
    for j in np.argsort(-x, kind="stable").tolist():
        pattern = chosen[j]
        times = min(int(x[j]), *(int(left[length]) // pattern.count(length) for length in pattern))
        if times > 0:
            out.append((times, pattern))
            for length in pattern:
                left[length] -= times
    return out + best_fit(left, capacity)


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of docs (doc_id, text).

    A row's ids are those of its text (null: none) and END_ID; only rows of more than ``capacity`` ids are cut, the first
    piece taking what is over. Each row counts, also when it repeats a doc_id or has none. Other columns are ignored; an
    empty table gives no rows. Pieces of equal length are ranked in groups of about a task's share, RANKED at most, so the driver
    sees one number for each length, task and RANKED pieces. Full pieces need no rank and take sequences of their own.
    """
    pieces = cut(token_pieces(docs, paths, capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    share = int(counts.sum()) // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = np.maximum(1, -(-counts // max(1, min(RANKED, share))))
    first_group = np.cumsum(groups) - groups
    # groups are looked up in an array of one small number for each length
    of_length = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), F.col("length").cast("int"))
    crowded = np.flatnonzero(groups > 1)
    if len(crowded):
        salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), of_length(groups)).cast("int")
        by_group = np.zeros(int(groups.sum()), np.int64)
        salted = pieces.filter(F.col("length") < capacity).withColumn("salt", salt)
        for row in salted.groupBy("length", "salt").count().collect():
            by_group[first_group[row["length"]] + row["salt"]] = row["count"]
        base = np.cumsum(by_group) - by_group
        base -= base[np.repeat(first_group, groups)]
    else:
        salted = pieces.filter(F.col("length") < capacity).withColumn("salt", F.lit(0))
        base = np.zeros(len(counts), np.int64)
    # each place of a pattern takes a range of ranks of its length; rank r goes to sequence first + r - low
    used = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int]] = []
    sequence = 0
    full, counts[capacity] = counts[capacity], 0
    for times, lengths in plan(counts, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, int(used[length]), sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    slot_length, low, first, offset = np.array(sorted(slots), np.int64).reshape(-1, 4).T
    key = slot_length << 48 | low

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank - 1 + base[first_group[length] + salt]
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            arrays = [*kept, pa.array(first[at] + rank - low[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked.mapInArrow(place, shape)
    # of a table that is cut, so a task that runs again gives the same numbers
    alone = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(sequence)).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(alone) if full else placed
