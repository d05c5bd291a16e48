"""Content hashes and the 64-bit SimHash of the article store."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newsloom.functions.text import _col, in_parts, nfkc, normalize_for_hash

SHINGLE, BANDS, MAX_DISTANCE = 3, 4, 3


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the normal form, in compatibility composition, in hex; NULL if that is empty."""
    return hash_of_normal(normalize_for_hash(nfkc(text)))


def hash_of_normal(normal: Column | str) -> Column:
    return F.when(_col(normal) != "", F.sha2(_col(normal), 256))


def simhash_words(words: list[str]) -> int | None:
    """Signed fingerprint of normalised words: for each bit the balance of the hashes of three-word shingles; under three words, none."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return None
    digests = b"".join(hashlib.blake2b(" ".join(words[i : i + SHINGLE]).encode(), digest_size=8).digest() for i in range(n))
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > n).view(">i8")[0])


@F.arrow_udf(LongType())
def _simhash(normal: pa.Array) -> pa.Array:
    return in_parts(normal, lambda t: simhash_words(t.split()), pa.int64())


def simhash64(text: Column | str) -> Column:
    """Fingerprint of a text's normal form, in compatibility composition, as a signed 64-bit number."""
    return _simhash(normalize_for_hash(nfkc(text)))


def simhash_of_normal(normal: Column | str) -> Column:
    return _simhash(_col(normal))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def bands(fingerprint: Column | str) -> Column:
    """Array of (band, value): four 16-bit parts, so that two fingerprints within three bits share one."""
    f = _col(fingerprint)
    return F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(f, 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("value")) for i in range(BANDS)))


#: Five blocks of a fingerprint: up to three differing bits leave two of them whole.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def block_keys(fingerprint: Column | str) -> Column:
    """Array of (pair, value): each pair of blocks as one key of about 26 bits. Fingerprints within MAX_DISTANCE share one, and
    others meet far less often than under one 16-bit band."""
    f = _col(fingerprint)
    part = [F.shiftrightunsigned(f, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS]
    pairs = [(i, j) for i in range(5) for j in range(i)]
    return F.array(*(F.struct(F.lit(5 * i + j).alias("band"), F.shiftleft(part[i], 13).bitwiseOR(part[j]).alias("value")) for i, j in pairs))
