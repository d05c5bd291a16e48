"""Repetition rules: characters inside repeated word n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernels import Words, blocks, grams

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Most percent of a text's word characters inside n-grams that stand earlier in it, by n.
REPEATED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent inside the places of the one most frequent n-gram, by n, if it has at least TOP_TIMES places.
TOP = {2: 20, 3: 18, 4: 16}
TOP_TIMES = 3
#: Most percent of lines, and of word characters in lines, that repeat an earlier line, if MIN_DUP_LINES or more do.
LINES, LINE_CHARS, MIN_DUP_LINES = 30, 20, 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value stands earlier, and places whose value stands twice or more."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    later = np.zeros(len(h), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return np.flatnonzero(later), np.flatnonzero(twice)


def _cover(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in the k words from one of the places."""
    turn = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + k, minlength=n + 1)[: n + 1]
    return np.cumsum(turn)[:n] > 0


def _top(h: np.ndarray, k: int, chars: np.ndarray) -> int:
    """Characters of the most frequent n-gram times its places; of equally frequent ones the longest counts."""
    values, first, count = np.unique(h, return_index=True, return_counts=True)
    most = count.max()
    if most < TOP_TIMES:
        return 0
    end = np.concatenate([[0], np.cumsum(chars)])
    first = first[count == most]
    return int(most * (end[first + k] - end[first]).max())


def measure_block(texts: list[bytes]) -> dict[str, list]:
    """The measures of each text."""
    words = Words(texts)
    h = words.hashes()
    point = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
    word_points = point[words.ends] - point[words.starts]
    inside = np.concatenate([[0], np.cumsum(word_points)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.buf])])
    by_n = {n: grams(h, n) for n in range(2, 11)}
    out: dict[str, list] = {k: [] for k in MEASURES}
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        n, chars = int(b - a), word_points[a:b]
        total = int(inside[b] - inside[a])
        seen: set[bytes] = set()
        n_lines = dup_lines = dup_chars = 0
        for line in text.split(b"\n"):
            if not line.strip():
                continue
            n_lines += 1
            if line in seen:
                dup_lines += 1
                dup_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            else:
                seen.add(line)
        of = lambda k: by_n[k][a : b - k + 1] if n >= k else np.zeros(0, np.uint64)  # noqa: B023, E731
        later, twice = _repeats(of(3))
        repeated = {k: 0 for k in REPEATED}
        if len(later):  # no longer n-gram is repeated if none of three words is
            for k in REPEATED:
                at, _ = _repeats(of(k))
                if not len(at):
                    break
                repeated[k] = int(chars[_cover(at, k, n)].sum())
        top = {k: _top(of(k), k, chars) if n >= k else 0 for k in TOP}
        row = {
            "n_words": n, "word_chars": total, "n_symbols": int(symbols[words.at[i + 1]] - symbols[words.at[i]]), "n_lines": n_lines, "n_dup_lines": dup_lines,
            "dup_line_chars": dup_chars, "n_repeat_words": int(_cover(twice, 3, n).sum()) if len(twice) else 0,
            "repeated_chars": [repeated[k] for k in REPEATED], "top_chars": [top[k] for k in TOP],
        }
        for k, v in row.items():
            out[k].append(v)
    return out


MEASURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_lines": pa.int64(), "n_dup_lines": pa.int64(),
    "dup_line_chars": pa.int64(), "n_repeat_words": pa.int64(), "repeated_chars": pa.list_(pa.int64()), "top_chars": pa.list_(pa.int64()),
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row of docs (doc_id, text); counts are of whole texts, a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch):
                found = measure_block(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[k], t) for k, t in MEASURES.items())], ["doc_id", *MEASURES])

    shape = ", ".join(f"{k} {'array<long>' if pa.types.is_list(t) else 'long'}" for k, t in MEASURES.items())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, {shape}")


def apply_rules(docs: DataFrame) -> DataFrame:
    """measures() with base_failed, kept and reasons (the rules that a text breaks, in a fixed order).

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of the words in 3-word windows that the text has twice or
    more. kept: neither that nor a limit of REPEATED, TOP, LINES or LINE_CHARS broken. All comparisons are of whole
    numbers. Each row is judged alone: repeated rows and null ids give rows like any other, an empty table none; other
    columns are ignored.
    """
    out = measures(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    over = lambda part, percent, whole: 100 * part > percent * whole
    rules = {f"repeated_{k}": over(F.col("repeated_chars")[i], p, F.col("word_chars")) for i, (k, p) in enumerate(REPEATED.items())}
    rules |= {f"top_{k}": over(F.col("top_chars")[i], p, F.col("word_chars")) for i, (k, p) in enumerate(TOP.items())}
    some = F.col("n_dup_lines") >= MIN_DUP_LINES
    rules |= {"lines": some & over(F.col("n_dup_lines"), LINES, F.col("n_lines")), "line_chars": some & over(F.col("dup_line_chars"), LINE_CHARS, F.col("word_chars"))}
    reasons = F.array_compact(F.array(F.when(failed, F.lit("base")), *(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return out.withColumn("base_failed", failed).withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)


