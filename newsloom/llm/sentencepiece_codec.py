"""SentencePiece encoding and decoding with the pieces and scores of a given model.

An Aho-Corasick automaton over the pieces reads the text once; at each position its output links give every piece that
ends there, and each relaxes the best score of that position (Viterbi). What a path's score is depends on the model:

* In a unigram model scores are log-probabilities of pieces, and a path has their sum.
* In a merge model (BPE) they only rank merges, so their sum means nothing. There a step from one piece to the next scores
  0 if the model's merges, applied to both together, leave them apart, and minus infinity if a merge would cross between
  them. A segmentation without a crossed boundary is what the merges of the whole give, so one path to each position has a
  finite score, and its ids are the model's own.

Characters that no piece covers, and only these, become byte pieces. If no piece has a space mark after another character,
words with the spaces before them are coded one by one, and repeated words only once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernels import blocks

MARK = "▁"
#: What a character without a piece scores below the least piece of a unigram model.
UNCOVERED = 10.0
#: Distinct words whose ids are remembered at least, and twice as many at most; pairs of pieces that are remembered at most.
CACHE, PAIRS = 1 << 18, 1 << 19
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_NEVER = float("-inf")


class Codec:
    """Pieces of one model: ids, scores, byte pieces and the automaton. ``merges`` says that scores rank merges."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], merges: bool = False):
        self.text_of = {i: p for p, _, i in pieces}
        self.score_of = {p: s for p, s, _ in pieces}
        self.scores = {i: s for _, s, i in pieces}
        self.characters = {p for p in self.score_of if len(p) == 1}
        self.byte_ids = byte_ids
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.merges = merges
        self.uncovered = min(self.score_of.values(), default=0.0) - UNCOVERED
        self.automaton = ahocorasick.Automaton()
        for piece, _, i in pieces:
            # a piece that no merges lead to is never part of their result
            if not merges or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        # words can be cut before a run of marks if marks stand only at the head of pieces
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, _ in pieces)
        self.seen: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        # what is known of pairs of pieces, by the first one's id
        self.pairs: list[dict[int, bool]] = [{} for _ in range(max(self.text_of, default=-1) + 1)] if merges else []
        self.n_pairs = 0
        self.bytes_of = {i: p.encode() for i, p in self.text_of.items()} | {i: bytes((b,)) for i, b in self.byte_of.items()}

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
        pieces, byte_ids = [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(_BYTE_PIECE.fullmatch(piece)[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((piece, model.get_score(i), i))
        return cls(pieces, byte_ids, spec.model_type == spec.BPE)

    def merged(self, text: str, boundary: int = 0) -> list[str]:
        """The characters of a short text after all merges: the best ranked pair first, of equal ones the leftmost. If a merge
        would cross the boundary, nothing."""
        parts = list(text)
        while True:
            ranks = [self.score_of.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(ranks, default=_NEVER)
            if best == _NEVER:
                return parts
            k = ranks.index(best)
            if boundary and sum(map(len, parts[: k + 1])) == boundary:
                return []
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def apart(self, before: int, i: int) -> bool:
        """Whether the merges leave piece i apart from the piece before it."""
        if self.n_pairs >= PAIRS:
            for row in self.pairs:
                row.clear()
            self.n_pairs = 0
        a = self.text_of[before]
        known = self.pairs[before][i] = bool(self.merged(a + self.text_of[i], len(a)))
        self.n_pairs += 1
        return known

    def viterbi(self, marked: str) -> list[int]:
        """Ids of the best segmentation; of equally good ones, the one whose last pieces are longest."""
        return self._one_path(marked) if self.merges else self._best_path(marked)

    def _one_path(self, marked: str) -> list[int]:
        """The path of a merge model, in which a score is 0 or minus infinity: a position's last piece is the one piece that ends
        there and stands apart from the last piece of the position before it. -2 is a position without a path yet, -1 one behind
        which a piece begins anew."""
        last = [-1] + [-2] * len(marked)
        size_of = [1] * (len(marked) + 1)
        lone = not self.characters.issuperset(marked)
        if lone:
            for at, c in enumerate(marked):
                if c not in self.characters:
                    last[at + 1] = -1
        pairs = self.pairs
        for end, (size, i) in self.automaton.iter(marked):
            end += 1
            if last[end] == -2:
                before = last[end - size]
                if before >= 0:
                    known = pairs[before].get(i)
                    if known is None:
                        known = self.apart(before, i)
                    if not known:
                        continue
                elif before == -2:
                    continue
                last[end] = i
                size_of[end] = size
        out: list[int] = []
        at = len(marked)
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(marked[at - 1].encode()))
            at -= size_of[at]
        out.reverse()
        return out

    def _best_path(self, marked: str) -> list[int]:
        """The path of a unigram model, by the sum of scores."""
        n = len(marked)
        best = [0.0] + [_NEVER] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0  # positions up to here are final
        for end, (size, i) in self.automaton.iter(marked):
            if done < end:
                self._settle(marked, best, back, done, end)
                done = end
            total, held = best[end + 1 - size] + self.scores[i], best[end + 1]
            if total > held or total == held and size > back[end + 1][0]:
                best[end + 1], back[end + 1] = total, (size, i)
        self._settle(marked, best, back, done, n)
        out: list[int] = []
        at = n
        while at:
            size, i = back[at]
            out.extend([i] if i >= 0 else [self.byte_ids[b] for b in reversed(marked[at - 1].encode())])
            at -= size
        return out[::-1]

    def _settle(self, marked: str, best: list[float], back: list[tuple[int, int]], done: int, upto: int) -> None:
        """Make positions final: a character without a piece can be written in bytes."""
        for at in range(done + 1, upto + 1):
            if marked[at - 1] not in self.characters and best[at - 1] + self.uncovered > best[at]:
                best[at], back[at] = best[at - 1] + self.uncovered, (1, -1)

    def encode(self, text: str) -> list[int]:
        """Ids of a text: a mark is put before it, and spaces become marks; an empty text has none."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.viterbi(marked)
        out: list[int] = []
        for word in _WORD.findall(marked):
            ids = self.seen.get(word)
            if ids is None:
                ids = self.before.get(word) or tuple(self.viterbi(word))
                # two generations: words that are met again move to the younger one
                if len(self.seen) >= CACHE:
                    self.before, self.seen = self.seen, {}
                self.seen[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters. Unknown ids are an error."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


# A run of marks with what follows it up to the next mark.
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@cache
def codec(path: str) -> Codec:
    return Codec.load(path)


def model_path() -> str:
    """The default model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_crc32, round_trip) of each row of docs (doc_id, text).

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers; round_trip says whether decode() gives the text back
    (it does unless the text has the space mark itself, which decode() gives as a space). A null text is empty and has no
    ids. Texts are read whole, however long. Each row stands alone: repeated rows and null ids give rows like any other,
    other columns are ignored, also such with names of the result, and an empty table gives no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part, texts in blocks(batch):
                ids, same = [], []
                for raw in texts:
                    text = raw.decode("utf-8", "replace")
                    ids.append(np.array(c.encode(text), "<i4"))
                    same.append(c.decode(ids[-1].tolist()) == text)
                n = [len(x) for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                arrays = [part.column("doc_id"), lists, pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"])

    shape = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, shape)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of encoded (doc_id, ids).

    Null or no ids give an empty text, bytes that are no UTF-8 replacement characters; an id that the model lacks, or a null
    one among others, is an error. Each row stands alone; other columns are ignored; an empty table gives no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
