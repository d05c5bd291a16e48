"""Quality classification by co-training.

Two logistic classifiers look at a document from different sides: one at its text (hashed words and proportions of
characters), one at the page's metadata (source, language, recorded length, layout of lines). Both start from labelled
documents. In each round either one goes over all documents without a label and hands those that it is sure of, with the
label it gives them, to the other, which is fitted anew and keeps what it learned if held-out labels agree. These also
calibrate each view and the weights of their sum, which scores all documents.

Features are taken from the texts once and written to the shared folder; rounds and scores read these small rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernels import Words, blocks, grams
from newsloom.session import stash

#: Bound of the labelled documents that are learned from, and how many times as many labels are tried for them.
MAX_LABELLED, TRIED = 4000, 4
ROUNDS = 3
#: A view hands over about so many documents in a round, split like the labels, of which it must be so sure. Such a label
#: counts less than a given one.
PER_ROUND, SURE, TRUST = 400, 0.95, 0.5
BUCKETS = 1 << 12
#: One labelled document in so many is held out: it calibrates the views and accepts rounds.
HELD_OUT = 3
#: Penalties of the views' weights and of the calibration's.
L2, L2_CALIBRATION = 1e-3, 1e-2

_CLASSES = {
    "symbol": b"#*$%&|<>{}[]~^\\=@_+", "digit": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "stop": b".!?", "comma": b",;:", "line": b"\n",
}
_TABLES = [np.isin(np.arange(256), list(v)) for v in _CLASSES.values()]
_STOP = _TABLES[3]
DENSE, LAYOUT = len(_TABLES) + 5, 5
SOURCES, LANGS, SIZES = 64, 16, 16
META = SOURCES + LANGS + SIZES
TEXT, PAGE = 0, 1


def text_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: text, bucket and count of each bucket of words that a text has, and dense features (texts, DENSE)."""
    h, n, of = words.hashes(), words.n, words.text_of()
    size = np.maximum(np.diff(words.at) - 1, 1)
    dense = np.zeros((len(n), DENSE))
    for k, table in enumerate(_TABLES):
        acc = np.concatenate([[0], np.cumsum(table[words.buf])])
        dense[:, k] = (acc[words.at[1:] - 1] - acc[words.at[:-1]]) / size
    some = np.maximum(n, 1)
    inside = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    dense[:, -5] = np.diff(inside[words.first]) / some / 10
    dense[:, -4] = np.log1p(n) / 10
    # words, and pairs of words, that stand in their text before
    for k, column in ((1, -3), (2, -2)):
        g = grams(h, k)
        within = of[: len(g)] == of[k - 1 :][: len(g)]
        g, home = g[within], of[: len(g)][within]
        _, first = np.unique(g ^ (home.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        dense[:, column] = (np.bincount(home, minlength=len(n)) - np.bincount(home[first], minlength=len(n))) / some
    dense[:, -1] = n == 0
    key, count = np.unique(of * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count, dense


def layout_features(words: Words) -> np.ndarray:
    """(texts, LAYOUT): how many lines, how long they and the longest are, how many are empty or end a sentence."""
    ends = np.flatnonzero(words.buf == 10)
    length = np.diff(np.concatenate([[-1], ends])) - 1
    of = np.searchsorted(words.at, ends, "right") - 1
    n = np.bincount(of, minlength=len(words.n))
    share = lambda flag: np.bincount(of, flag, minlength=len(n)) / n
    longest = np.maximum.reduceat(length, np.searchsorted(of, np.arange(len(n))))
    return np.stack([np.log1p(n), np.log1p(share(length)), np.log1p(longest), share(length == 0), share((length > 0) & _STOP[words.buf[ends - 1]])], 1)


def page_places(source: list, lang: list, n_chars: list) -> np.ndarray:
    """(documents, 3) columns of the metadata view that are one; a null has a place of its own."""
    place = lambda x, n: n - 1 if x is None else zlib.crc32(str(x).encode()) % (n - 1)
    length = [SIZES - 1 if x is None or x < 0 else min(int(x).bit_length(), SIZES - 2) for x in n_chars]
    rows = [(place(s, SOURCES), SOURCES + place(g, LANGS), SOURCES + LANGS + k) for s, g, k in zip(source, lang, length, strict=True)]
    return np.array(rows, np.int64).reshape(-1, 3)


FEATURES = "bucket array<int>, count array<int>, place array<int>, dense array<float>"


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def _feature_arrays(texts: list[bytes], source: list, lang: list, n_chars: list) -> list[pa.Array]:
    words = Words(texts)
    of, bucket, count, dense = text_features(words)
    per, n = np.bincount(of, minlength=len(texts)), len(texts)
    both = np.hstack([dense, layout_features(words)]) if n else np.zeros((0, DENSE + LAYOUT))
    return [
        _lists(bucket, per, pa.int32()), _lists(count, per, pa.int32()), _lists(page_places(source, lang, n_chars).ravel(), np.full(n, 3), pa.int32()),
        _lists(both.ravel().astype(np.float32), np.full(n, DENSE + LAYOUT), pa.float32()),
    ]


@dataclass
class Sparse:
    """Rows of one view: the columns and values of its sparse part with their rows, and dense columns after these."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int
    dense: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Weighted sum of each row, the last weight being the bias; it doesn't depend on the other rows."""
        return np.bincount(self.row, w[self.column] * self.value, minlength=len(self.dense)) + (self.dense * w[self.width : -1]).sum(1) + w[-1]

    def gradient(self, e: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, e[self.row] * self.value, minlength=self.width), e @ self.dense, [e.sum()]])

    def take(self, rows: np.ndarray) -> Sparse:
        at = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=len(self.dense)))])
        size = at[rows + 1] - at[rows]
        pick = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(rows) else np.zeros(0, np.int64)
        return Sparse(np.repeat(np.arange(len(rows)), size), self.column[pick], self.value[pick], self.width, self.dense[rows])


def views(rows: pa.RecordBatch | pa.Table) -> tuple[Sparse, Sparse]:
    """Both views of rows with FEATURES."""

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)

    n = rows.num_rows
    (bucket, size), (count, _), (place, _), (dense, _) = (flat(c) for c in ("bucket", "count", "place", "dense"))
    row = np.repeat(np.arange(n), size)
    words = np.bincount(row, count, minlength=n)
    dense = dense.reshape(n, DENSE + LAYOUT).astype(float)
    text = Sparse(row, bucket.astype(np.int64), count / np.sqrt(words)[row], BUCKETS, dense[:, :DENSE])
    return text, Sparse(np.repeat(np.arange(n), 3), place.astype(np.int64), np.ones(len(place)), META, dense[:, DENSE:])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 150, l2: float = L2) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression, by Adam on the whole set."""
    weight = np.ones(len(y)) if weight is None else weight
    w = m = s = np.zeros(x.width + x.dense.shape[1] + 1)
    decay = np.append(np.full(len(w) - 1, l2), 0.0)
    for t in range(1, steps + 1):
        g = x.gradient((_sigmoid(x.dot(w)) - y) * weight / weight.sum()) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def _dense(*columns: np.ndarray) -> Sparse:
    none = np.zeros(0, np.int64)
    return Sparse(none, none, np.zeros(0), 0, np.stack(columns, 1))


@dataclass
class Model:
    """Weights and scale of the dense columns of both views, and the calibration: bias and slope of each view, and of their sum."""

    weights: list[np.ndarray]
    scales: list[tuple[np.ndarray, np.ndarray]]
    calibration: np.ndarray
    #: Held-out loss of the text view, the metadata view and both after each round, that before the first one foremost.
    losses: list[tuple[float, float, float]] = field(default_factory=list)

    def scaled(self, both: tuple[Sparse, Sparse]) -> tuple[Sparse, ...]:
        return tuple(Sparse(x.row, x.column, x.value, x.width, (x.dense - mean) / spread) for x, (mean, spread) in zip(both, self.scales, strict=True))

    def score(self, both: tuple[Sparse, Sparse]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, of the metadata view and of both."""
        c = self.calibration
        z = [x.dot(w) for x, w in zip(self.scaled(both), self.weights, strict=True)]
        a, b = c[0] + c[1] * z[TEXT], c[2] + c[3] * z[PAGE]
        return _sigmoid(a), _sigmoid(b), _sigmoid(c[4] + c[5] * a + c[6] * b)


def _loss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1))


def _better(before: np.ndarray, after: np.ndarray) -> bool:
    """Whether losses fell on the mean, by more than the standard error of the fall."""
    fall = before - after
    return fall.mean() > fall.std() / np.sqrt(len(fall))


#: What a round's search gets: the model, the share of labels 1 and the round; what it gives: rows with FEATURES, the view that is
#: sure of each, and its label.
Search = Callable[[Model, float, int], tuple[pa.Table, np.ndarray, np.ndarray]]


def learn(labelled: pa.Table, y: np.ndarray, search: Search | None = None, rounds: int = ROUNDS) -> Model | None:
    """A model from rows with FEATURES and their labels; None without labels of both kinds. ``search`` finds what the views
    hand to each other."""
    if len(set(y.tolist())) < 2:
        return None
    fold = np.arange(len(y)) % HELD_OUT == 0
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold = np.zeros(len(y), bool)
    train = np.flatnonzero(~fold)
    test = np.flatnonzero(fold) if fold.any() else train
    raw = views(labelled)
    scales = [(x.dense[train].mean(0), x.dense[train].std(0) + 1e-6) for x in raw]
    model = Model([], scales, np.zeros(7))
    given = model.scaled(raw)
    held = [x.take(test) for x in given]
    # what each view has learned from the other: rows, labels
    gained: list[tuple[list[Sparse], list[np.ndarray]]] = [([], []), ([], [])]

    def fitted(v: int, rows: list[Sparse], labels: list[np.ndarray]) -> np.ndarray:
        parts = [given[v].take(train), *rows]
        begin = np.concatenate([[0], np.cumsum([len(p.dense) for p in parts])])
        x = Sparse(
            np.concatenate([p.row + b for p, b in zip(parts, begin, strict=False)]), np.concatenate([p.column for p in parts]), np.concatenate([p.value for p in parts]),
            parts[0].width, np.concatenate([p.dense for p in parts]),
        )
        label = np.concatenate([y[train], *labels])
        trust = np.concatenate([np.ones(len(train)), *(np.full(len(a), TRUST) for a in labels)])
        ones = (trust * label).sum() / trust.sum()
        return logistic(x, label, trust * np.where(label == 1, 0.5 / ones, 0.5 / (1 - ones)))

    def calibrated(w: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        c: list[float] = []
        logits = []
        for x, weights in zip(held, w, strict=True):
            z = x.dot(weights)
            slope, bias = logistic(_dense(z), y[test], l2=L2_CALIBRATION)
            c += [bias, slope]
            logits.append(bias + slope * z)
        both = logistic(_dense(*logits), y[test], l2=L2_CALIBRATION)
        c += [both[2], both[0], both[1]]
        total = both[2] + both[0] * logits[0] + both[1] * logits[1]
        return np.array(c), [_loss(_sigmoid(z), y[test]) for z in (*logits, total)]

    model.weights = [fitted(v, *gained[v]) for v in (TEXT, PAGE)]
    model.calibration, losses = calibrated(model.weights)
    model.losses.append(tuple(float(x.mean()) for x in losses))
    for turn in range(rounds if search else 0):
        rows, view, label = search(model, float(y.mean()), turn)
        if not rows.num_rows:
            break
        kept = False
        for v, x in enumerate(model.scaled(views(rows))):
            # what the other view is sure of
            pick = np.flatnonzero(view == 1 - v)
            if not len(pick):
                continue
            more = [*gained[v][0], x.take(pick)], [*gained[v][1], label[pick].astype(float)]
            tried = list(model.weights)
            tried[v] = fitted(v, *more)
            calibration, after = calibrated(tried)
            # given labels have the last word on what the guessed ones taught
            if _better(losses[v], after[v]) and after[2].mean() <= losses[2].mean():
                gained[v], model.weights, model.calibration, losses, kept = more, tried, calibration, after, True
        model.losses.append(tuple(float(x.mean()) for x in losses))
        if not kept:
            break
    return model


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bucket, count, place, dense) of each row of docs: its features, and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                arrays = _feature_arrays(texts, *(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *arrays], ["doc_id", "key", "bucket", "count", "place", "dense"])

    columns = [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"), F.col("text").cast("binary").alias("text")]
    metadata = [F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    return docs.select(*columns, *metadata).mapInArrow(run, f"doc_id long, key long, {FEATURES}")


def labelled_rows(rows: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED) -> tuple[pa.Table, np.ndarray]:
    """Features and labels of ``most`` labelled documents at most, in order of a hash of doc_id, out of TRIED times as many labels.
    A label counts if it is 0 or 1; of several the greatest, of several texts under one doc_id that with the least hash."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ticket = F.xxhash64("doc_id")
    # labels can be of documents that aren't there, so more are tried than taken; both numbers are bounds, fit for a broadcast
    tried = known.orderBy(ticket, "doc_id").limit(TRIED * most)
    met = rows.join(F.broadcast(tried), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("key", "bucket", "count", "place", "dense")).alias("f"))
    found = met.select(ticket.alias("ticket"), "doc_id", "label", "f.*").orderBy("ticket", "doc_id").limit(most).toArrow()
    return found, found.column("label").to_numpy().astype(float)


def pool_search(rows: DataFrame, known: np.ndarray, per_round: int = PER_ROUND, sure: float = SURE) -> Search:
    """A search over all rows but the known doc_ids (sorted): counts what each view is sure of, then takes about as many as
    wanted of each kind, by a hash that is drawn anew each round, copies of a text once."""

    def verdicts(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        doc = batch.column("doc_id").fill_null(-1).to_numpy()
        at = np.minimum(np.searchsorted(known, doc), max(len(known) - 1, 0))
        free = known[at] != doc if len(known) else np.ones(len(doc), bool)
        scores = model.score(views(batch))
        for v in (TEXT, PAGE):
            for label in (0, 1):
                p = scores[v] if label else 1 - scores[v]
                yield v, label, free & (p >= sure)

    def search(model: Model, ones: float, turn: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        want = {(v, label): max(1, round(per_round * (ones if label else 1 - ones))) for v in (TEXT, PAGE) for label in (0, 1)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = dict.fromkeys(want, 0)
            for batch in batches:
                for v, label, good in verdicts(model, batch):
                    seen[v, label] += int(good.sum())
            columns = zip(*((v, label, n) for (v, label), n in seen.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["view", "label", "n"])

        counts = rows.mapInArrow(count, "view long, label long, n long").groupBy("view", "label").agg(F.sum("n").alias("n")).collect()
        share = {(r["view"], r["label"]): min(1.0, 2 * want[r["view"], r["label"]] / max(r["n"], 1)) for r in counts}

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ticket = batch.column("ticket").to_numpy()
                for v, label, good in verdicts(model, batch):
                    at = pa.array(np.flatnonzero(good & (ticket < share.get((v, label), 0.0) * (1 << 53))))
                    part = batch.take(at)
                    kind = [pa.array(np.full(len(at), x), pa.int64()) for x in (v, label)]
                    yield pa.RecordBatch.from_arrays([*kind, *(part.column(c) for c in ("ticket", "key", "bucket", "count", "place", "dense"))], ["view", "label", "ticket", "key", "bucket", "count", "place", "dense"])

        drawn = rows.withColumn("ticket", F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(turn)), 11))
        found = drawn.mapInArrow(pick, f"view long, label long, ticket long, key long, {FEATURES}").toArrow()
        found = found.sort_by([(c, "ascending") for c in ("view", "label", "ticket", "key")])
        v, label, key = (found.column(c).to_numpy() for c in ("view", "label", "key"))
        taken, left, used = [], dict(want), set()
        for i, kind in enumerate(zip(v.tolist(), label.tolist(), key.tolist(), strict=True)):
            if kind not in used and left[kind[:2]]:
                used.add(kind)
                left[kind[:2]] -= 1
                taken.append(i)
        return found.take(pa.array(taken, pa.int64())), v[taken], label[taken]

    return search


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of each row of docs (doc_id, text, source, lang, n_chars).

    Scores are calibrated probabilities that the label is 1; keep is score >= 0.5. Labels other than 0 and 1 and null
    doc_ids teach nothing; of several labels of a document the greatest counts. If the labels are all alike, or there are
    none, all scores are 0.5 and everything is kept. At most MAX_LABELLED labelled documents are learned from; what the
    views teach each other comes from all others. Null text is empty, null metadata have a place of their own. Texts are
    read whole. Equal rows get equal scores, however often they come; other columns are ignored, also such with names of
    the result; an empty table gives no rows.
    """
    rows = stash(features(docs))
    known, y = labelled_rows(rows, labels, label)
    model = learn(known, y, pool_search(rows, np.sort(known.column("doc_id").to_numpy())), rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.round(p, 9) for p in model.score(views(batch))] if model else [np.full(batch.num_rows, 0.5)] * 3
            arrays = [batch.column("doc_id"), *(pa.array(s) for s in scores), pa.array(scores[2] >= 0.5)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_score", "meta_score", "score", "keep"])

    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
