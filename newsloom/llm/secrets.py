"""Secret scanning: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels the tokens of a line O, B or I (outside, begin, inside of a secret). Features of a token are its shape
(length, kinds of characters, changes between them), its neighbours (the words before it, hashed, and kinds: key words,
separators, quotes) and its file (how much punctuation and how many digits it has). Weights are learned in numpy from lines of the corpus, labelled by
the fixed patterns, and from made-up lines with secrets and look-alikes; the best labels of a line come from Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernels import blocks, span_hashes

# The fixed patterns and the least lengths of their matches (of the value, for an assignment).
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: A necessary condition of a match, for the training sample.
LOOKS_LIKE = r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}"
KINDS = ("assign", "access", "hex", "crf")

#: Words that announce a secret, as whole tokens in lower case.
KEY_WORDS = (
    "password passwd passphrase pwd secret client_secret token access_token auth_token auth authorization bearer apikey api_key api-key "
    "key access_key secret_key private_key credential credentials"
).split()
#: Bounds of the training sample: lines of the corpus with a match of the fixed patterns, and any lines, in parts of at most
#: LINE_CHARS; and made-up lines.
MATCHED, PLAIN_LINES, LINE_CHARS = 400, 400, 160
MADE_UP = 600
EPOCHS = 70
O, B, I = 0, 1, 2

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 line end, 2 word, 3 other
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x0A] = 1
_CLASS[[b for b in range(256) if b >= 0x80 or chr(b).isalnum() or chr(b) in "+/_.-"]] = 2
_DIGIT, _UPPER, _LOWER, _MARK, _HEX = (np.zeros(256, bool) for _ in range(5))
_DIGIT[list(b"0123456789")] = True
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LOWER[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True
_MARK[list(b"+/_.-")] = True
_HEX[list(b"0123456789abcdef")] = True
_FOLD = np.arange(256, dtype=np.uint8)  # A-Z as a-z
_FOLD[_UPPER] += 32
_KIND = np.zeros(256, np.uint8)  # what a character is for the count of changes
_KIND[_DIGIT], _KIND[_UPPER], _KIND[_LOWER] = 1, 2, 3
_LENGTHS = np.array([2, 4, 8, 12, 16, 24, 40])
#: Token kinds that neighbours see.
PLAIN, KEY, EQUALS, COLON, QUOTE, PUNCTUATION, RANDOM, EDGE = range(8)
_PUNCT_KIND = np.full(256, PUNCTUATION, np.uint8)
_PUNCT_KIND[ord("=")], _PUNCT_KIND[ord(":")], _PUNCT_KIND[[ord('"'), ord("'")]] = EQUALS, COLON, QUOTE
#: Places of hashed words.
WORD_PLACES = 256
#: Values of each feature: shape, characters, hex, own kind, three kinds before, one after, own shape with the nearest kinds, file,
#: the nearest and the second nearest word before, bias.
SIZES = (8 * 16, 3 * 4 * 4, 2 * 4, 8, 8, 8, 8, 8, 8 * 64, 9 * 8, WORD_PLACES, WORD_PLACES, 1)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of the fixed patterns' matches, by start and then kind."""
    out = []
    if b"=" in text or b":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Tokens:
    """Tokens of a block of texts: runs of word characters and single other characters; ``line`` numbers lines over the block."""

    def __init__(self, texts: list[bytes]):
        self.buf = buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _CLASS[buf]
        head = kind >= 2
        head[1:] &= (kind[1:] == 3) | (kind[:-1] != 2)
        tail = kind >= 2
        tail[:-1] &= (kind[:-1] == 3) | (kind[1:] != 2)
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.line = np.cumsum(kind == 1)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.text = np.searchsorted(self.at, self.starts, "right") - 1

    def features(self) -> np.ndarray:
        """(tokens, features) places in the weight table."""
        buf, s, e = self.buf, self.starts, self.ends
        n = len(s)
        out = np.zeros((n, len(SIZES)), np.int32)
        if not n:
            return out
        size = e - s
        word = _CLASS[buf[s]] == 2

        def count(table: np.ndarray) -> np.ndarray:
            acc = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int32)])
            return acc[e] - acc[s]

        digits, upper, lower, marks = count(_DIGIT), count(_UPPER), count(_LOWER), count(_MARK)
        kinds = _KIND[buf]
        change = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(kinds[1:] != kinds[:-1], out=change[1 : len(buf)], dtype=np.int32)
        change = change[e - 1] - change[s]
        length = np.searchsorted(_LENGTHS, size, "right")
        random = word & (size >= 12) & (digits > 0) & (change >= 3)
        own = np.where(word, PLAIN, _PUNCT_KIND[buf[s]])
        own[random] = RANDOM
        for i in self._maybe_keys(word, size, digits):
            if bytes(buf[s[i] : e[i]]).lower() in _KEYS:
                own[i] = KEY
        shape = length * 16 + (digits > 0) * 8 + (upper > 0) * 4 + (lower > 0) * 2 + (marks > 0)
        share = lambda x: np.minimum(x * 4 // np.maximum(size, 1), 3)
        hexed = word & (count(_HEX) == size)
        out[:, 0] = shape
        out[:, 1] = (np.searchsorted([1, 4], change, "right") * 4 + share(digits)) * 4 + share(upper)
        out[:, 2] = hexed * 4 + np.minimum(length // 2, 3)
        out[:, 3] = own
        for column, step in ((4, -1), (5, -2), (6, -3), (7, 1)):
            near = np.full(n, EDGE, np.int32)
            a, b = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -1), slice(1, None))
            if n > abs(step):
                near[a] = np.where(self.line[a] == self.line[b], own[b], EDGE)
            out[:, column] = near
        out[:, 8] = np.minimum(length, 7) * 64 + out[:, 4] * 8 + out[:, 5]
        # the file: shares of punctuation and digits in three steps each, with the length
        total = np.maximum(np.diff(self.at), 1)
        part = lambda table, cuts: np.searchsorted(cuts, np.diff(np.concatenate([[0], np.cumsum(table[buf])])[self.at]) / total, "right")
        file = part(_CLASS == 3, [0.03, 0.12]) * 3 + part(_DIGIT, [0.01, 0.1])
        out[:, 9] = file[self.text] * 8 + np.minimum(length, 7)
        # words of the line before a token, wherever separators stand between; place 0: none
        at = np.flatnonzero(word)
        place = (span_hashes(_FOLD[buf], s[at], e[at]) >> np.uint64(32)).astype(np.int64) % (WORD_PLACES - 1) + 1
        before = np.concatenate([[0], np.cumsum(word)[:-1]]) - 1
        for column, back in ((10, 0), (11, 1)):
            k = np.maximum(before - back, 0)
            if len(at):
                near = (before >= back) & (self.line[at[k]] == self.line)
                out[:, column] = np.where(near, place[k], 0)
        return out + OFFSETS[:-1].astype(np.int32)

    def _maybe_keys(self, word: np.ndarray, size: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Tokens with the length and the first two letters of a key word."""
        fits = np.flatnonzero(word & _KEY_SIZE[np.minimum(size, 31)] & (digits == 0))
        s = self.starts[fits]
        return fits[_KEY_HEAD[self.buf[s] | 0x20, self.buf[s + 1] | 0x20]]


_KEYS = {k.encode() for k in KEY_WORDS}
_KEY_SIZE, _KEY_HEAD = np.zeros(32, bool), np.zeros((256, 256), bool)
for _k in _KEYS:
    _KEY_SIZE[len(_k)] = True
    _KEY_HEAD[_k[0], _k[1]] = True


@dataclass
class Field:
    """Weights of the features for each label, and of label transitions; a line begins and ends outside."""

    w: np.ndarray
    t: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        """(tokens, labels) scores."""
        out = self.w[features[:, 0]].copy()
        for i in range(1, features.shape[1]):
            out += self.w[features[:, i]]
        return out

    def viterbi(self, u: np.ndarray) -> np.ndarray:
        """The best labels of one line; of equally good ones, that with the lower labels last."""
        t = self.t.tolist()
        score = [t[O][k] + x for k, x in enumerate(u[0].tolist())]
        back = []
        for row in u[1:].tolist():
            step, came = [], []
            for k in range(3):
                best = max(range(3), key=lambda a: (score[a] + t[a][k], -a))  # noqa: B023
                step.append(score[best] + t[best][k] + row[k])
                came.append(best)
            score = step
            back.append(came)
        k = max(range(3), key=lambda a: (score[a] + t[a][O], -a))
        out = [k]
        for came in reversed(back):
            k = came[k]
            out.append(k)
        return np.array(out[::-1])

    def labels(self, u: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best labels of all lines. Where no token of a line could gain by being in a secret, whatever its neighbours,
        the line is outside; only other lines are decoded."""
        out = np.zeros(len(u), np.int64)
        if not len(u):
            return out
        extra = self.t - self.t[O, O]
        leave = max(0.0, float(extra[[B, I], O].max()))
        gain = (u[:, [B, I]] - u[:, [O]] + extra[:, [B, I]].max(0)).max(1)
        lines = np.unique(line[gain > -leave])
        begin, end = np.searchsorted(line, lines), np.searchsorted(line, lines, "right")
        for a, b in zip(begin, end, strict=True):
            out[a:b] = self.viterbi(u[a:b])
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(features: np.ndarray, line: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Field:
    """Maximum conditional likelihood with a small L2 term: exact gradients by the forward-backward algorithm over all lines at once, Adam."""
    lines, first, size = np.unique(line, return_index=True, return_counts=True)
    n, length = len(lines), int(size.max())
    slot = np.repeat(np.arange(n), size), np.arange(len(line)) - np.repeat(first, size)
    live = np.zeros((n, length), bool)
    live[slot] = True
    field = Field(np.zeros((OFFSETS[-1], 3)), np.zeros((3, 3)))
    field.t[O, I] = -4.0  # a secret begins before it goes on
    gold = np.zeros_like(field.w)
    for k in range(3):
        gold[:, k] = np.bincount(features[y == k].ravel(), minlength=OFFSETS[-1])
    gold_t = np.zeros((3, 3))
    before = np.concatenate([[O], y[:-1]])
    before[first] = O
    np.add.at(gold_t, (before, y), 1)
    last = np.concatenate([first[1:] - 1, [len(y) - 1]]) if n else first
    np.add.at(gold_t, (y[last], np.full(n, O)), 1)
    m_w, s_w, m_t, s_t = np.zeros_like(field.w), np.zeros_like(field.w), np.zeros((3, 3)), np.zeros((3, 3))
    for epoch in range(1, epochs + 1):
        u = np.zeros((n, length, 3))
        u[slot] = field.unary(features)
        t = field.t
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = t[O] + u[:, 0]
        for i in range(1, length):
            step = _log_sum(alpha[:, i - 1, :, None] + t, 1) + u[:, i]
            alpha[:, i] = np.where(live[:, i, None], step, alpha[:, i - 1])
        end = size - 1
        beta[np.arange(n), end] = t[:, O]
        for i in range(length - 2, -1, -1):
            step = _log_sum(t + (u[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where((i < end)[:, None], step, beta[:, i])
        z = _log_sum(alpha[:, -1] + t[:, O], 1)
        p = np.exp(alpha + beta - z[:, None, None])[slot]
        g_w = np.stack([np.bincount(features.ravel(), np.repeat(p[:, k], features.shape[1]), OFFSETS[-1]) for k in range(3)], 1) - gold
        pair = np.exp(alpha[:, :-1, :, None] + t + (u + beta)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        g_t = pair.sum((0, 1)) - gold_t
        g_t[O] += np.exp(t[O] + u[:, 0] + beta[:, 0] - z[:, None]).sum(0)
        g_t[:, O] += np.exp(alpha[:, -1] + t[:, O] - z[:, None]).sum(0)
        g_w = g_w / n + 1e-4 * field.w
        g_t = g_t / n + 1e-4 * field.t
        for value, g, m, s in ((field.w, g_w, m_w, s_w), (field.t, g_t, m_t, s_t)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            value -= 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.99**epoch)) + 1e-8)
    return field


def made_up_lines(n: int, seed: int = 1) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Lines with the byte spans of their secrets: keys with random values in several forms, and look-alikes with none."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + letters + "0123456789+/"
    draw = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    words = lambda k: " ".join(draw(letters, int(rng.integers(2, 10))) for _ in range(k))
    out = []
    for _ in range(n):
        quote = str(rng.choice(["", '"', "'"]))
        kind = int(rng.integers(8))
        secret = draw([base64[:62], "0123456789abcdef", base64[:62] + "-_", base64, base64[:62]][int(rng.integers(5))], int(rng.integers(16, 45)))
        secret = secret[:8] + str(rng.integers(10)) + secret[8:]
        head, tail = words(int(rng.integers(0, 6))), words(int(rng.integers(0, 6)))
        key = str(rng.choice(KEY_WORDS)).replace("key", str(rng.choice(["key", "Key", "KEY"])))
        if kind < 3:
            lead = f"{head} {key}{rng.choice([' = ', '=', ': ', ':', ' : '])}{quote}"
        elif kind == 3:
            lead = f"{head} authorization: bearer "
            quote = ""
        elif kind == 4:
            lead, quote, secret = f"{head} ", "", f"AKIA{draw(base64[:26] + '0123456789', 16)}"
        else:
            fake = [
                f"{draw(letters, 6)}={rng.integers(10**6)}", f"https://www.{draw(letters, 8)}.com/{draw(letters, 6)}-{draw(letters, 9)}/{rng.integers(10**5)}", f"{rng.integers(2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
                f"({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}", f"{draw(letters, 24)}", f"{key}: {words(2)}", f"{draw(letters, 7)}.{rng.integers(99)}@{draw(letters, 9)}.com", f"v{rng.integers(9)}.{rng.integers(20)}.{rng.integers(99)}", f"{words(1)}-{words(1)}-{words(1)}",
            ]
            out.append((f"{head} {rng.choice(fake)} {tail}".encode(), []))
            continue
        line = f"{lead}{secret}{quote} {tail}"
        out.append((line.encode(), [(len(lead), len(lead) + len(secret))]))
    return out


def value_spans(text: bytes) -> list[tuple[int, int]]:
    """The secrets themselves in the fixed patterns' matches (of an assignment, its value)."""
    out = [(m.start(), m.end()) for m in HEX.finditer(text)]
    out += [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    return out + [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]


def learn(lines: list[bytes], made_up: int = MADE_UP) -> Field:
    """A field from lines of the corpus, labelled by the fixed patterns, and from made-up lines."""
    known = [(line, value_spans(line)) for line in lines] + made_up_lines(made_up)
    tokens = Tokens([x for x, _ in known])
    y = np.zeros(len(tokens.starts), np.int64)
    for i, (_, spans) in enumerate(known):
        for a, b in spans:
            lo = np.searchsorted(tokens.ends, tokens.at[i] + a, "right")
            hi = np.searchsorted(tokens.starts, tokens.at[i] + b)
            y[lo:hi] = I
            y[lo : lo + 1] = B
    return train(tokens.features(), tokens.line, y)


def training_lines(docs: DataFrame, matched: int = MATCHED, plain: int = PLAIN_LINES) -> list[bytes]:
    """So many lines (in parts of LINE_CHARS at most) with what looks like a match of the fixed patterns, and so many of all
    lines, by a hash of place and text; every line of every text can be drawn."""
    parts = F.regexp_extract_all("text", F.lit(f"[^\n]{{1,{LINE_CHARS}}}"), 0)

    def drawn(some: DataFrame, test: Column, most: int) -> list[bytes]:
        lines = some.select("doc_id", F.posexplode(parts).alias("pos", "line")).filter(test)
        first = lines.select(F.xxhash64("doc_id", "pos", "line").alias("ticket"), "line").orderBy("ticket", "line").limit(most)
        return [r["line"].encode() for r in first.collect()]

    known = docs.filter("text is not null")
    looks = lambda c: F.col(c).rlike(LOOKS_LIKE)
    return drawn(known.filter(looks("text")), looks("line"), matched) + drawn(known, F.lit(True), plain)


def scan_block(texts: list[bytes], field: Field) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) in bytes of all spans of each text: the fixed patterns', and the field's that aren't wholly within these."""
    tokens = Tokens(texts)
    y = field.labels(field.unary(tokens.features()), tokens.line)
    out = [base_spans(t) for t in texts]
    inside = np.flatnonzero(y)
    if len(inside):
        new = (y[inside] == B) | np.concatenate([[True], np.diff(inside) > 1]) | np.concatenate([[True], np.diff(tokens.line[inside]) > 0])
        heads = inside[new]
        tails = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(inside) - 1]])
        for a, b in zip(heads, inside[tails], strict=True):
            i = int(tokens.text[a])
            start, end = int(tokens.starts[a] - tokens.at[i]), int(tokens.ends[b] - tokens.at[i])
            out[i].append((start, end, "crf"))
    final = []
    for spans in out:
        base = [s for s in spans if s[2] != "crf"]
        own = [s for s in spans if s[2] == "crf" and not _within(s, base)]
        final.append(sorted(base + own, key=lambda s: (s[0], KINDS.index(s[2]))))
    return final


def _within(span: tuple[int, int, str], base: list[tuple[int, int, str]]) -> bool:
    """Do the base spans (by start), overlapping and adjacent ones as one, leave nothing of the span?"""
    at = span[0]
    for a, b, _ in base:
        if a <= at < b:
            at = b
    return at >= span[1]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, field: Field | None = None, redact: str | None = None) -> DataFrame:
    """docs with secrets: array of (kind, start, end) in code points, end exclusive, by start and then kind; with ``redact``,
    text has each span (overlapping ones as one) replaced by that string.

    The field is learned from a bounded sample of the lines of docs unless one is given. Whole texts are scanned; a null text is empty
    (and stays null). Results depend on the text alone, so repeated rows and null ids are like any other. Other columns
    are kept, one named secrets is replaced. An empty table gives no rows.
    """
    field = field or learn(training_lines(docs))
    docs = docs.drop("secrets")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                found, changed = [], []
                for text, spans in zip(texts, scan_block(texts, field), strict=True):
                    found.append(_points(text, spans))
                    if redact is not None:
                        changed.append(_replace(text, spans, redact.encode()))
                columns = {c: part.column(c) for c in names}
                if redact is not None:
                    # texts with no span keep their value, null too
                    columns["text"] = pa.array([c if f else t for c, f, t in zip(changed, found, part.column("text").to_pylist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, pa.list_(SPAN))], [*names, "secrets"])

    # text travels once, as bytes
    shape = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, f"{shape}, secrets array<struct<kind:string,start:long,end:long>>")
    return out.withColumn("text", F.col("text").cast("string"))


def _points(text: bytes, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Spans in code points."""
    if not spans:
        return []
    if text.isascii():
        return [{"kind": k, "start": a, "end": b} for a, b, k in spans]
    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"kind": k, "start": int(point[a]), "end": int(point[b])} for a, b, k in spans]


def _replace(text: bytes, spans: list[tuple[int, int, str]], by: bytes) -> bytes:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return b"".join([*out, text[at:]])
