"""Vector and score expressions."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Numerically safe softmax of an ``array<double>``."""
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based position of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sentiment_score(probs: Column) -> Column:
    """Positive minus negative probability of (negative, neutral, positive)."""
    return F.element_at(probs, 3) - F.element_at(probs, 1)


def polarity(score: Column, cut: float = 0.33) -> Column:
    return F.when(score < -cut, "negative").when(score > cut, "positive").otherwise("neutral")


def predict_with_thresholds(scores: Column, thresholds: list[float]) -> Column:
    """Highest class index whose score reaches its threshold; 0 if none does."""
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.transform(
        F.arrays_zip(scores.alias("s"), cuts.alias("t")),
        lambda z, i: F.when(z["s"] >= z["t"], i),
    )
    return F.coalesce(F.array_max(reached), F.lit(0)).cast("int")


def hash_number(*parts: Column) -> Column:
    """60-bit non-negative integer from the md5 of the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_key(*parts: Column) -> Column:
    """md5 hex of the parts joined by '|': a reproducible random order."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_FIRST = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _md5_start(block: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the md5 of padded one-block messages (n, 64), as big-endian numbers."""
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(len(block), v, np.uint32) for v in _FIRST)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[g]
        turn = np.uint32(_TURNS[i])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    ends = [(x + v).byteswap().astype(np.uint64) for x, v in ((a, _FIRST[0]), (b, _FIRST[1]))]
    return (ends[0] << np.uint64(32)) | ends[1]


def hash_numbers(starts: list[str], sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``hash_number`` of many texts: each start, which ends in '|', is followed by as many of the
    numbers ``places`` (0 and above) as ``sizes`` says.

    Messages of one md5 block, all but those with very long starts, are worked out side by side.
    """
    raw = [s.encode() for s in starts]
    long = np.fromiter(map(len, raw), np.int64, len(raw))
    block = np.zeros((len(raw), 64), np.uint8)
    for row, s in zip(block, raw):
        row[: min(len(s), 64)] = np.frombuffer(s[:64], np.uint8)
    block, at = np.repeat(block, sizes, axis=0), np.repeat(long, sizes)
    i = places.astype(np.int64)
    digits = np.ones(len(i), np.int64)
    while (more := i >= 10**digits).any():
        digits += more
    fits = np.flatnonzero(at + digits <= 55)
    for j in range(int(digits.max(initial=0))):
        rows = fits[digits[fits] > j]
        block[rows, at[rows] + j] = 48 + i[rows] // 10 ** (digits[rows] - 1 - j) % 10
    size = (at + digits)[fits]
    block[fits, size] = 0x80
    block[fits, 56], block[fits, 57] = size * 8 & 255, size * 8 >> 8
    found = np.empty(len(i), np.uint64)
    found[fits] = _md5_start(block[fits])
    texts = np.repeat(np.arange(len(raw)), sizes)
    for row in np.flatnonzero(at + digits > 55):
        found[row] = int.from_bytes(md5(raw[texts[row]] + b"%d" % i[row]).digest()[:8])
    return (found >> np.uint64(4)).astype(np.int64)
