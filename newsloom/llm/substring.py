"""Exact removal of repeated passages by relative Lempel-Ziv parsing.

The whole corpus is the reference, in blocks that start at content-defined anchors: the least hash of the WINDOW - GRAM + 1
word n-grams (n = GRAM) in a window is its anchor, so equal windows, wherever they stand, have equal anchors. A block is
the run of windows under one anchor; it is indexed by its anchor and by a hash of its words.

Index entries are range-partitioned by anchor, block, document and place, so one pass over each range meets equal blocks
together, earliest first, and no anchor is too common for one task. A block that stood before is matched as a whole. Blocks
that stand for the first time, but whose anchor has other blocks too, are the edges of passages: what is repeated in them
may end or begin at any word.

Each document is parsed twice. The first parse, over matched blocks, makes factors: from a place on, the longest run of
blocks that goes on in the same earlier passage. It decides what is checked at factor boundaries: of the windows in edges,
those that reach beyond the factors ask for their earliest equal window (others only answer). The second parse is over
blocks and windows found: from left to right it takes the longest factor, goes on behind its end, and looks at the windows
that lie across that end for a factor of their own. The words of factors, each of WINDOW words at least, are the duplicate
spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernels import Words, blocks, grams, mix, signed, sliding_min
from newsloom.session import plain_join, stash

WINDOW = 20
GRAM = 8
_U = np.uint64
_LOW = 20


class Anchored(Words):
    """The blocks of some texts: ``text``, ``anchor``, ``block`` (hashes), ``start`` (word in its text) and ``size`` (windows)."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        words = self.hashes()
        n = max(0, len(words) - WINDOW + 1)
        of = self.text_of()
        inside = of[:n] == of[WINDOW - 1 :][:n] if n else np.zeros(0, bool)
        window = np.flatnonzero(inside)
        if not len(window):
            self.text = self.start = self.size = np.zeros(0, np.int64)
            self.anchor = self.block = np.zeros(0, _U)
            return
        of = of[window]
        g = grams(words, GRAM)
        # the place in the low bits: ties go to the leftmost
        low = _U((1 << _LOW) - 1)
        least = sliding_min((g & ~low) | (np.arange(len(g), dtype=_U) & low), WINDOW - GRAM + 1)[window]
        at = window + (((least & low).astype(np.int64) - window) & ((1 << _LOW) - 1))
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
        head = np.flatnonzero(new)
        self.size = np.diff(np.append(head, len(at)))
        self.text = of[head]
        self.anchor = g[at[head]]
        self.start = window[head] - self.first[self.text]
        # a block is no longer than its first and last windows together
        whole = grams(words, WINDOW)
        self.block = mix(whole[window[head]] * _U(3) + whole[window[head] + self.size - 1] * _U(5) + self.size.astype(_U))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in blocks(batch):
            b = Anchored(texts)
            if len(b.text):
                at = pa.array(b.text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(b.anchor)), pa.array(signed(b.block)), part.column("doc_id").take(at), part.column("mark").take(at), pa.array(b.start.astype(np.int32)), pa.array(b.size.astype(np.int32))],
                    ["anchor", "block", "doc_id", "mark", "start", "size"],
                )


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of index entries in order: places of blocks that stand before in the range, with the first place, and
    (with null) first places of blocks whose anchor has other blocks too or touches an end of the range."""
    began = None  # the range's first anchor
    anchor = block = np.zeros(1, np.int64)
    head = np.zeros((3, 1), np.int64)
    held: tuple[np.ndarray, bool] | None = None  # the last first place, and whether it is known to be needed

    def batch_of(place, size, source=None):
        kinds = (pa.int64(), pa.int32(), pa.int32())
        columns = [*(pa.array(c, t) for c, t in zip(place, kinds, strict=True)), pa.array(size, pa.int32())]
        columns += [pa.nulls(len(size), t) for t in kinds] if source is None else [pa.array(c, t) for c, t in zip(source, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "start", "size", "from_doc", "from_mark", "from_start"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, size = (batch.column(c).to_numpy() for c in ("anchor", "block", "size"))
        place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "mark", "start")])
        new_anchor = np.concatenate([[began is None or a[0] != anchor[0]], a[1:] != a[:-1]])
        new = new_anchor | np.concatenate([[began is None or b[0] != block[0]], b[1:] != b[:-1]])
        began = a[0] if began is None else began
        firsts = np.flatnonzero(new)
        source = np.concatenate([head, place[:, firsts]], 1)[:, np.cumsum(new)]
        copy = ~new & (source != place).any(0)
        if copy.any():
            yield batch_of(place[:, copy], size[copy], source[:, copy])
        if len(firsts):
            beside = ~new_anchor[firsts]  # another block of the anchor comes before
            need = beside | (a[firsts] == began)
            need[:-1] |= beside[1:]
            if held is not None and (held[1] or beside[0]):
                yield batch_of(held[0][:3], held[0][3])
            pick = firsts[:-1][need[:-1]]
            if len(pick):
                yield batch_of(place[:, pick], size[pick])
            last = firsts[-1:]
            held = np.concatenate([place[:, last], [size[last]]]), bool(need[-1])
        anchor, block = a[-1:], b[-1:]
        head = source[:, -1:]
    if held is not None:
        yield batch_of(held[0][:3], held[0][3])


class Matches:
    """Repeated windows of one document, in runs that go on in the same earlier passage: windows ``begin`` to ``end`` - 1, and the
    place (document, text mark, word) of the first one's source."""

    def __init__(self, start: np.ndarray, size: np.ndarray, source: np.ndarray):
        order = np.argsort(start, kind="stable")
        start, size, source = start[order], size[order], source[:, order]
        go = (np.diff(start) == size[:-1]) & (np.diff(source[:2], axis=1) == 0).all(0) & (np.diff(source[2]) == size[:-1])
        head = np.concatenate([[0], np.flatnonzero(~go) + 1]) if len(start) else np.zeros(0, np.int64)
        tail = np.concatenate([head[1:], [len(start)]]) - 1 if len(start) else head
        self.begin, self.end = start[head], start[tail] + size[tail]
        self.source = source[:, head]

    def parse(self) -> list[tuple[int, int, int, int, int]]:
        """Factors (start, words, source) from left to right. A factor is the longest one from where the parse stands, which then
        goes on behind it; windows across its end, which the parse would pass over, are checked for a factor of their own."""
        out: list[tuple[int, int, int, int, int]] = []
        at, i = 0, 0
        while i < len(self.begin):
            # the longest factor from ``at``, or from the first place after it that has one
            out.append(self._factor(i, max(at, int(self.begin[i]))))
            at = out[-1][0] + out[-1][1]
            i += 1
            # boundary: windows that start before the factor's end and reach beyond it
            while i < len(self.begin) and self.begin[i] < at:
                if self.end[i] + WINDOW - 1 > at:
                    out.append(self._factor(i, int(self.begin[i])))
                    at = out[-1][0] + out[-1][1]
                i += 1
        return out

    def _factor(self, i: int, start: int) -> tuple[int, int, int, int, int]:
        doc, mark, word = self.source[:, i].tolist()
        return start, int(self.end[i]) + WINDOW - 1 - start, doc, mark, word + start - int(self.begin[i])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lists of structs (a null one is empty), and the fields of all of them, one after the other; null: -1."""
    flat = column.flatten()
    fields = [flat.field(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields)]
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), fields


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the edges in ``found``: 96 bits of hash, place, and whether they reach beyond the factors of matched blocks."""
    for batch in batches:
        for part, texts in blocks(batch):
            words = Words(texts)
            h = words.hashes()
            count, (start, size, *source) = _lists(part.column("found"))
            source = np.stack(source)
            edge = source[2] < 0
            # words under the factors of the first parse
            covered = np.zeros(len(h) + 1, np.int32)
            at = 0
            for i, n in enumerate(count.tolist()):
                hit = np.flatnonzero(~edge[at : at + n]) + at
                if len(hit):
                    for a, k, *_ in Matches(start[hit], size[hit], source[:, hit]).parse():
                        covered[words.first[i] + a] += 1
                        covered[words.first[i] + a + k] -= 1
                at += n
            free = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) == 0)])
            text = np.repeat(np.arange(len(texts)), count)[edge]
            start, size = start[edge], size[edge]
            text = np.repeat(text, size)
            start = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            if not len(start):
                continue
            at = start + words.first[text]
            ask = free[at + WINDOW] > free[at]
            more = (grams(h, WINDOW - 1)[at] >> _U(32)).astype(np.uint32).view(np.int32)
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(grams(h, WINDOW)[at])), pa.array(more), part.column("doc_id").take(of), part.column("mark").take(of), pa.array(start.astype(np.int32)), pa.array(ask)],
                ["w", "x", "doc_id", "mark", "start", "ask"],
            )


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text as bytes); mark tells apart the texts of rows that repeat a doc_id."""
    mark = F.hash(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), mark.alias("mark"), F.col("text").cast("binary").alias("text"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, start, size, from_doc, from_mark, from_start): runs of windows that also start earlier, and where; those that
    reach beyond no factor of matched blocks are left out."""
    known = _marked(docs).filter("doc_id is not null")
    order = ["anchor", "block", "doc_id", "mark", "start"]
    index = known.mapInArrow(_index, "anchor long, block long, doc_id long, mark int, start int, size int").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stash(index.mapInArrow(_match, "doc_id long, mark int, start int, size int, from_doc long, from_mark int, from_start int"))
    hit = F.struct("start", "size", "from_doc", "from_mark", "from_start")
    per_doc = found.groupBy("doc_id", "mark").agg(F.collect_set(hit).alias("found")).filter(F.exists("found", lambda x: x["from_doc"].isNull()))
    windows = known.join(per_doc, ["doc_id", "mark"]).mapInArrow(_windows, "w long, x int, doc_id long, mark int, start int, ask boolean")
    place = F.struct("doc_id", "mark", "start")
    # minima before the join: a window in very many blocks is one row of it
    least = windows.groupBy("w", "x").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
    again = plain_join(windows.filter("ask"), least, ["w", "x"]).filter(F.col("first") < place)
    return found.filter("from_doc is not null").unionByName(
        again.select("doc_id", "mark", "start", F.lit(1).alias("size"), F.col("first.doc_id").alias("from_doc"), F.col("first.mark").alias("from_mark"), F.col("first.start").alias("from_start"))
    )


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("text", "n_words", "n_removed", "factors")}
        lengths, parts = _lists(batch.column("hits"))
        start, size, source = parts[0], parts[1], np.stack(parts[2:])
        at = 0
        for text, n in zip(batch.column("text").to_pylist(), lengths.tolist(), strict=True):
            words = (text or b"").split()
            factors = Matches(start[at : at + n], size[at : at + n], source[:, at : at + n]).parse()
            at += n
            keep = np.ones(len(words), bool)
            for begin, k, *_ in factors:
                keep[begin : begin + k] = False
            out["text"].append(b" ".join(compress(words, keep)))
            out["n_words"].append(len(words))
            out["n_removed"].append(int(len(words) - keep.sum()))
            out["factors"].append([{"start": s, "words": w, "from_doc": d, "from_start": f} for s, w, d, _, f in factors])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("from_doc", pa.int64()), ("from_start", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["text"], pa.binary()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["factors"], kind)],
            ["doc_id", "text", "n_words", "n_removed", "factors"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed, factors) for each row of docs (doc_id, text): text has the kept words, joined by one space.

    A word goes if a window of WINDOW words over it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Windows are judged on the input. A null text has no words; shorter texts than a window stay whole. Rows with
    a null doc_id are kept whole and are no source. Rows that repeat a doc_id with the same text are one document, given
    as often; other texts under one doc_id are documents of their own, in order of a hash. factors tells the spans that go
    and where they stood before. Texts are read whole; a document's spans meet in one row. Other columns are ignored; an
    empty table gives no rows.
    """
    hit = F.struct("start", "size", "from_doc", "from_mark", "from_start")
    per_doc = repeated_windows(docs).groupBy("doc_id", "mark").agg(F.collect_set(hit).alias("hits"))
    shape = "doc_id long, text binary, n_words long, n_removed long, factors array<struct<start:int,words:int,from_doc:long,from_start:int>>"
    return _marked(docs).join(per_doc, ["doc_id", "mark"], "left").mapInArrow(_clean, shape).withColumn("text", F.col("text").cast("string"))
