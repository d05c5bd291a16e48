"""numpy kernels over batches of whole texts (UTF-8 bytes).

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` uses the same set. Hashes are polynomial
modulo 2**64 with a final mix, taken from prefix sums, so a batch costs a fixed number of passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one go. Only a single longer document makes a larger block.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
_BASES = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xD1342543DE82EF95 | 1}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if kind not in _powers or len(_powers[kind][0]) <= n:
        base, size = _BASES[kind], max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=_U))
        _powers[kind] = (out[0], out[1])
    return _powers[kind]


def blocks(batch: pa.RecordBatch, name: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batch whose texts have about ``most`` bytes, with these texts; a null one counts as empty."""
    size = np.cumsum(pc.add(pc.fill_null(pc.binary_length(batch.column(name)), 0), 1).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(size):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + most, "right")))
        part = batch.slice(begin, end - begin)
        yield part, [t or b"" for t in part.column(name).to_pylist()]
        begin = end


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _power("byte", len(buf))
    acc = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * down[starts])


class Words:
    """Words of a block of texts: byte ranges in ``buf``, and for each text the range ``first[i]:first[i + 1]`` of its words."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = SPACE[self.buf]
        turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            turn = np.concatenate([[0], turn])
        self.starts, self.ends = turn[0::2], turn[1::2]
        self.at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first = np.searchsorted(self.starts, self.at)
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return span_hashes(self.buf, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """The index of the text that each word is in."""
        return np.repeat(np.arange(len(self.n)), self.n)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of h; len(h) - k + 1 values (none if h is shorter)."""
    if len(h) < k:
        return np.zeros(0, _U)
    up, down = _power("word", len(h) + 1)
    acc = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[: len(h)], out=acc[1:])
    m = len(h) - k + 1
    return mix((acc[k:] - acc[:m]) * down[:m] + _U(k))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, span = v, 1
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(v) - w + 1], out[w - span :][: len(v) - w + 1])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
