"""Packing of tokenised documents by deficit round-robin over source queues.

Each source's documents, in the order of their partitions, are a queue of tokens. Windows are filled one after the other: in each
one every queue is credited its share of WINDOW tokens and serves whole grains of GRAIN tokens (its last one may be shorter) while
its credit covers them; what is left of the credit, less than a grain, is the deficit that it carries into the next window. The
windows make one stream, which is cut into sequences; what is over at its end makes sequences of powers of two, so none is padded.

After w windows a queue with weight t of T has been credited t * w * WINDOW / T, so what it has served follows from w alone:
deficits need no pass through the windows, and each partition starts with those that the ones before it leave. The driver
holds one number for each source: the tokens of its queue.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import cache, lru_cache
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.kernels import blocks
from newsloom.session import stash

CAPACITY = 2048
END_ID = 1
#: Tokens of a window, and of a grain.
WINDOW = 32 * CAPACITY
GRAIN = 256
#: Remembered pieces of text of each of two generations.
REMEMBERED = 400_000

# The tokenizer's own words, of characters that it lower-cases as Python does and doesn't compose.
_SURE = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^0-9a-zß-öø-ſ]+")


def tokenizer_path() -> str:
    """The default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Ids of whole texts by the tokenizer, which drops white space: what stands between is encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        size = self.full.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = [i.to_bytes(self.kind.itemsize, "little") for i in range(size)]
        self.letters = _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        """Ids of one of the tokenizer's own words, in lower case."""
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            text = word.decode() if word.isascii() else "".join(self.letters[b] for b in word)
            found = self.young[word] = b"".join([self.code[t.id] for t in self.model.tokenize(text)])
        return found

    def _fresh(self, chunk: bytes) -> bytes:
        if chunk.islower() and chunk[:-1].isalpha():
            # most are a word, or one with a mark behind it
            last = chunk[-1:]
            if last.isalpha():
                return self._word(chunk)
            if last in b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'":
                return self._word(chunk[:-1]) + self._word(last)
        text = chunk.decode("utf-8", "replace")
        if "<|" not in text and _SURE.fullmatch(text):
            return b"".join([self._word(w.encode()) for w in _WORDS.findall(text.lower())])
        return b"".join([self.code[i] for i in self.full.encode(text, add_special_tokens=False).ids])

    def __call__(self, text: bytes) -> bytes:
        """The ids, in ``kind``, one after the other."""
        # special tokens are told by their case
        chunks = (text if b"<|" in text else text.lower()).split()
        young = self.young
        for c in set(chunks).difference(young):
            young[c] = self.old.get(c) or self._fresh(c)
        out = b"".join(map(young.__getitem__, chunks))
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def queued(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(part, queue, before, doc_id, source, n, ids) of each row: its tokens, and how many of its queue stand before it in its
    partition. A null source is a queue of its own."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        end, size = np.array([END_ID], encode.kind).tobytes(), encode.kind.itemsize
        upto: dict[str | None, int] = {}
        for batch in batches:
            for rows, texts in blocks(batch):
                ids = [encode(t) + end for t in texts]
                n, before = [len(x) // size for x in ids], []
                for queue, k in zip(rows.column("queue").to_pylist(), n, strict=True):
                    before.append(upto.get(queue, 0))
                    upto[queue] = before[-1] + k
                columns = [pa.array([part] * len(n), pa.int32()), rows.column("queue"), pa.array(before, pa.int64()), rows.column("doc_id"), rows.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "queue", "before", "doc_id", "source", "n", "ids"])

    source = F.col("source").cast("string")
    queue = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    read = docs.select(F.col("doc_id").cast("long"), source.alias("source"), queue.alias("queue"), F.col("text").cast("binary").alias("text"))
    return stash(read.mapInArrow(run, "part int, queue string, before long, doc_id long, source string, n long, ids binary"))


class Schedule:
    """Where each token of each queue goes. ``tokens`` has the length of each queue, ``weights`` its share of a window.

    While no queue runs dry the shares stay; a window in which one does ends a phase, and the rest share the next one's. Queues
    without a weight come after all others, by their lengths.
    """

    def __init__(self, tokens: Mapping[str, int], weights: Mapping[str, int], window: int = WINDOW, grain: int = GRAIN):
        self.window, self.grain = window, grain
        self.names = sorted(q for q, n in tokens.items() if n)
        self.index = {q: i for i, q in enumerate(self.names)}
        left = [tokens[q] for q in self.names]
        share = [weights.get(q, 0) for q in self.names]
        self.phases: list[tuple[int, int, list[int], list[int], int]] = []  # first position, first window, weights, left, sum of weights
        self.served: list[list[int]] = [[] for _ in left]  # of each queue, its tokens before each phase
        position = windows = 0
        done = [0] * len(left)
        while any(left):
            active = [t if n else 0 for t, n in zip(share, left, strict=True)]
            if not any(active):
                active = share = left.copy()
            total = sum(active)
            for i, n in enumerate(done):
                self.served[i].append(n)
            self.phases.append((position, windows, active, left.copy(), total))
            lasts = min(-(-n * total // (t * window)) for n, t in zip(left, active, strict=True) if t)
            gone = self._after(len(self.phases) - 1, lasts)
            left = [a - b for a, b in zip(left, gone, strict=True)]
            done = [a + b for a, b in zip(done, gone, strict=True)]
            position, windows = position + sum(gone), windows + lasts
        self.total = position
        self._window = lru_cache(512)(self._window)

    def _one(self, t: int, n: int, total: int, windows: int) -> int:
        """What a queue of n tokens has served after so many windows of its phase."""
        credit = t * windows * self.window // total
        return n if t and credit >= n else credit - credit % self.grain

    def _after(self, phase: int, windows: int) -> list[int]:
        _, _, active, left, total = self.phases[phase]
        return [self._one(t, n, total, windows) for t, n in zip(active, left, strict=True)]

    def _window(self, phase: int, w: int) -> tuple[list[int], list[int], list[int]]:
        """Of each queue, its tokens served before and after the window, and the position of the first one in it."""
        a, b = self._after(phase, w), self._after(phase, w + 1)
        at, starts = self.phases[phase][0] + sum(a), []
        for x, y in zip(a, b, strict=True):
            starts.append(at)
            at += y - x
        return a, b, starts

    def places(self, queue: str, begin: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(offset in the document, length, position in the stream, window) of the runs of n tokens from ``begin`` of the queue."""
        i = self.index[queue]
        offset = 0
        while offset < n:
            phase = bisect_right(self.served[i], begin + offset) - 1
            _, first_window, active, left, total = self.phases[phase]
            here = begin + offset - self.served[i][phase]
            covered = min(here - here % self.grain + self.grain, left[i])
            w = -(-covered * total // (active[i] * self.window)) - 1
            a, b, starts = self._window(phase, w)
            length = min(n - offset, b[i] - here)
            yield offset, length, starts[i] + here - a[i], first_window + w
            offset += length


def sequence_starts(rest: int) -> list[int]:
    """Where the sequences of the last ``rest`` tokens begin, and their end: powers of two, in descending order."""
    out = [0]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append(out[-1] + (1 << bit))
    return out


def _whole(weights: Mapping[str | None, float]) -> dict[str, int]:
    """Weights of queues as whole numbers of the same proportions."""
    exact = {"-" if s is None else f"+{s}": Fraction(str(w)) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights can't be negative")
    scale = lcm(*(w.denominator for w in exact.values()))
    return {q: int(w * scale) for q, w in exact.items()}


def pack(docs: DataFrame, weights: Mapping[str | None, float] | None = None, path: str | None = None, capacity: int = CAPACITY, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window) of each piece of docs (doc_id, text, source).

    A row's ids are those of its text (null: none) and END_ID. ``weights`` are the target token proportions of sources; without
    them, those of the whole table, so that all queues run dry together. A queue that runs dry leaves its share to the others;
    sources without a weight follow at the end. All sequences are full but for those at the end, whose lengths are powers
    of two. Each row counts, repeated or without an id; a null source is one like any other. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = queued(docs, path)
    by_part = rows.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    tokens = {r["queue"]: r["n"] for r in by_part.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    targets = tokens if weights is None else _whole(weights)
    kind = encoder(path or tokenizer_path()).kind
    total = sum(tokens.values())
    full = total // capacity
    tail = sequence_starts(total - full * capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(tokens, targets, window, grain)
        names = ("doc_id", "source", "n", "queue", "begin", "ids")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                _, _, n, queue, begin, ids = (part.column(c).to_pylist() for c in names)
                found: list[tuple[int, ...]] = []
                for i, (k, q, a, raw) in enumerate(zip(n, queue, begin, ids, strict=True)):
                    words = np.frombuffer(raw, kind).astype("<u4")
                    for start, length, at, w in schedule.places(q, a, k):
                        while length:
                            if at < full * capacity:
                                sequence, offset = divmod(at, capacity)
                                room = capacity - offset
                            else:
                                j = bisect_right(tail, at - full * capacity) - 1
                                sequence, offset = full + j, at - full * capacity - tail[j]
                                room = tail[j + 1] - tail[j] - offset
                            size = min(length, room)
                            found.append((i, start, size, zlib.crc32(words[start : start + size]), sequence, offset, w))
                            start, at, length = start + size, at + size, length - size
                row, start, size, crc, sequence, offset, w = np.array(found, np.int64).reshape(-1, 7).T
                of = lambda c, row=pa.array(row), part=part: part.column(c).take(row)
                columns = [of("doc_id"), pa.array(start), pa.array(size), pa.array(crc), of("n"), pa.array(sequence), pa.array(offset), of("source"), pa.array(w)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window"])

    placed = rows.join(bases, ["part", "queue"]).select("doc_id", "source", "n", "queue", (F.col("base") + F.col("before")).alias("begin"), "ids")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long")
