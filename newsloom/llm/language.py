"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes fall into classes (letters without case, one class of digits, white space, punctuation, each continuation byte, lead
bytes), classes have embeddings, filters of several widths run over fixed-length windows, the greatest response of each
filter goes to a softmax layer. A text's windows cover it from end to end; its probabilities are the mean over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernels import blocks, mix

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Bound of the training sample: about so many windows of labelled texts of each language.
WINDOWS_PER_LANGUAGE = 1600
EPOCHS = 6
BATCH = 64
UNKNOWN = "und"


def _byte_classes() -> tuple[np.ndarray, int]:
    names: list[object] = []
    for b in range(256):
        c = chr(b)
        if b < 0x80:
            kind = c.lower() if c.isalpha() else "0" if c.isdigit() else " " if b <= 0x20 or b == 0x7F else c if c in ".,;:'\"!?()-" else "#"
        else:
            kind = b if b < 0xF0 else 0xF0
        names.append(kind)
    order = [" ", *sorted({str(n) for n in names} - {" "})]
    return np.array([order.index(str(n)) for n in names], np.uint8), len(order)


CLASS_OF, CLASSES = _byte_classes()
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True


class Network:
    """Parameters of the network; ``langs`` are the labels in the order of the softmax layer."""

    def __init__(self, langs: list[str], seed: int = 8):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (CLASSES, EMBEDDING)), "v": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))), "c": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients and mean loss for windows x (n, WINDOW) and labels y."""
        p, n = self.p, len(x)
        pooled, best = [], []
        for w in WIDTHS:
            m = WINDOW - w + 1
            response = sum((p["e"] @ p[f"w{w}"][j])[x[:, j : j + m]] for j in range(w))
            at = response.argmax(1)
            best.append(at)
            pooled.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0] + p[f"b{w}"])
        z = np.concatenate(pooled, 1)
        a = np.maximum(z, 0)
        logits = a @ p["v"] + p["c"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        loss = float(-np.log(q[np.arange(n), y] + 1e-9).mean())
        q[np.arange(n), y] -= 1
        q /= n
        g = {"v": a.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        dz = (q @ p["v"].T) * (z > 0)
        for i, w in enumerate(WIDTHS):
            d = dz[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = d.sum(0)
            g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                seen = np.take_along_axis(x, best[i] + j, 1).astype(np.int64)
                t = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), d.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS).astype(np.float32)
                g["e"] += t @ p[f"w{w}"][j].T
                g[f"w{w}"][j] = p["e"].T @ t
        return g, loss

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 8) -> Network:
        """Adam over shuffled batches."""
        rng, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                g, _ = self.step(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= (0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, responses of neighbouring pairs of classes (or a last single one) by place in the filter."""
        p, out = self.p, {}
        for w in WIDTHS:
            single = [(p["e"] @ p[f"w{w}"][j]).astype(np.float32) for j in range(w)]
            out[w] = [(j, (single[j][:, None] + single[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                out[w].append((w - 1, single[w - 1]))
        return out

    def predict(self, x: np.ndarray, tables: dict[int, list[tuple[int, np.ndarray]]]) -> np.ndarray:
        """Probabilities (n, languages) of windows x."""
        out = np.zeros((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), 128):
            part = x[i : i + 128].astype(np.int32)
            pairs = part[:, :-1] * CLASSES + part[:, 1:]
            pooled = []
            for w in WIDTHS:
                m = WINDOW - w + 1
                response = None
                for j, table in tables[w]:
                    got = table.take((pairs if len(table) > CLASSES else part)[:, j : j + m], axis=0)
                    response = got if response is None else np.add(response, got, out=response)
                pooled.append(response.max(1) + self.p[f"b{w}"])
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["v"] + self.p["c"]
            logits = np.exp(logits - logits.max(1, keepdims=True))
            out[i : i + 128] = logits / logits.sum(1, keepdims=True)
        return out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all windows of the texts, the last of each filled up with spaces, and the number of windows of each text."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    padded = b"".join(t.ljust(int(k) * WINDOW) for t, k in zip(texts, n, strict=True))
    return CLASS_OF[np.frombuffer(padded, np.uint8)].reshape(-1, WINDOW), n


def has_letter(text: bytes) -> bool:
    if _LETTER[np.frombuffer(text[:256], np.uint8)].any() or _LETTER[np.frombuffer(text, np.uint8)].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def held_out() -> F.Column:
    """Documents that nothing is learned from; one without a doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _drawn(text: bytes, ticket: int, share: float) -> bytes:
    """The windows of a text that a hash of their place draws, one after the other, the last filled up with spaces."""
    n = -(-len(text) // WINDOW)
    if not n or not has_letter(text):
        return b""
    draws = mix(np.arange(n, dtype=np.uint64) + np.uint64(ticket & (1 << 64) - 1)) >> np.uint64(11)
    at = np.flatnonzero(draws < np.uint64(share * (1 << 53)))
    return b"".join(text[i * WINDOW : (i + 1) * WINDOW].ljust(WINDOW) for i in at.tolist())


def training_sample(docs: DataFrame, per_language: int = WINDOWS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """(lang, windows) of about per_language windows of each language; every window of every labelled text can be drawn. Held-out
    documents and nulls are left out. Texts stay where they are: the driver gets the windows."""
    known = docs.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out())
    n = F.sum(F.ceil(F.octet_length("text") / WINDOW))
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col("lang").cast("string").alias("lang")).agg(n.alias("n")).collect()}
    shares = {lang: min(1.0, per_language / n) for lang, n in counts.items() if n}
    if not shares:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                lang, h = part.column("lang").to_pylist(), part.column("h").to_pylist()
                drawn = [_drawn(t, k, shares.get(g, 0.0)) for t, g, k in zip(texts, lang, h, strict=True)]
                some = [i for i, w in enumerate(drawn) if w]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in some], t) for x, t in ((lang, pa.string()), (h, pa.int64()), (drawn, pa.binary()))], ["lang", "h", "windows"])

    picked = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("binary").alias("text"))
    rows = picked.mapInArrow(run, "lang string, h long, windows binary").collect()
    return [(r["lang"], bytes(r["windows"])) for r in sorted(rows, key=lambda r: (r["h"], r["lang"], bytes(r["windows"])))]


def learn(sample: list[tuple[str, bytes]]) -> Network | None:
    """A network trained on windows; None without any."""
    langs = sorted({lang for lang, _ in sample})
    x = CLASS_OF[np.frombuffer(b"".join(w for _, w in sample), np.uint8)].reshape(-1, WINDOW)
    y = np.repeat([langs.index(lang) for lang, _ in sample], [len(w) // WINDOW for _, w in sample])
    return Network(langs).train(x, y) if len(x) else None


def identify(docs: DataFrame, model: Network | None = None) -> DataFrame:
    """docs with lang_pred and score (0 to 1), by a network learned from docs itself unless one is given.

    A text that is null or has no letter is ``und`` with score 0, as is every text if there is nothing to learn from. Of equally
    probable languages the first in order of name is taken. Whole texts are classified, window by window. Only ``text`` is
    an input of a prediction, so equal texts get equal results and null ids don't matter. Other columns are
    kept; ones named lang_pred or score are replaced. An empty table gives no rows.
    """
    model = model or learn(training_sample(docs))
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            for part, texts in blocks(batch):
                label: list[str] = [UNKNOWN] * len(texts)
                score = np.zeros(len(texts))
                x, n = windows(texts)
                if model and len(x):
                    q = model.predict(x, tables)
                    some = np.flatnonzero(n)
                    begin = np.concatenate([[0], np.cumsum(n)])[some]
                    mean = np.add.reduceat(q.astype(np.float64), begin, axis=0) / n[some][:, None]
                    for i, m in zip(some, mean, strict=True):
                        if has_letter(texts[i]):
                            label[i] = model.langs[int(m.argmax())]
                            score[i] = min(1.0, round(float(m.max()), 5))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(label), pa.array(score)], [*names, "lang_pred", "score"])

    # text travels once, as bytes
    shape = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, f"{shape}, lang_pred string, score double")
    return out.withColumn("text", F.col("text").cast("string"))
