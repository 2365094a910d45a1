"""Quality rules on repetition, found with suffix arrays over the words of each document.

A batch of documents is sorted at once: word codes carry their document, so no two suffixes of
different documents are ever equal, and prefix doubling goes on only for suffixes that still share
their rank with another.  The ranks of every round give the longest common prefix of neighbours.
The deepest common-prefix interval above a suffix is the longest repeated substring that starts
there; the union of those spans is what all maximal repeats cover.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, slices

MIN_WORDS = 50
WINDOW = 3
#: Repeats of fewer words than this are ordinary phrases.
MIN_REPEAT = 5
#: A document may be covered by repeats up to this share of its words.
MAX_COVERED = 0.3
#: The longest repeat may have so many words.
MAX_REPEAT = 100

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"

COLUMNS = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False)]
    + [T.StructField(n, T.LongType(), False) for n in ("covered_words", "longest_repeat")]
)


def repeat_lengths(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every position the words of the longest substring that starts there and occurs again
    in the same document.  ``codes`` are word numbers, ``doc`` non-decreasing document numbers."""
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    ends = np.searchsorted(doc, doc, side="right")
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    size = np.diff(np.r_[first, n])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(first, size)
    levels = [rank.astype(np.int32)]
    active = order[np.repeat(size > 1, size)]
    h = 1
    while active.size:
        after = active + h
        inside = after < ends[active]
        following = np.where(inside, rank[np.where(inside, after, n)], -1)
        key = rank[active] * (n + 1) + following + 1
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        base = rank[active]
        new = np.r_[True, key[1:] != key[:-1]]
        old = np.r_[True, base[1:] != base[:-1]]
        at = np.arange(len(key))
        sub = np.flatnonzero(new)
        size = np.diff(np.r_[sub, len(key)])
        rank[active] = base + np.repeat(sub, size) - np.maximum.accumulate(np.where(old, at, 0))
        levels.append(rank.astype(np.int32))
        active = active[np.repeat(size > 1, size)]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank[:n]] = np.arange(n)
    # longest common prefixes of neighbours that share their first word
    left, right = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][left] == levels[0][right])
    i, j = left[pairs], right[pairs]
    a, b = i.copy(), j.copy()
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][a] == levels[level][b]
        step = same * (1 << level)
        a, b = a + step, b + step
    common = a - i
    np.maximum.at(longest, i, common)
    np.maximum.at(longest, j, common)
    return longest


def covered(lengths: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Whether each position lies in a span of at least ``least`` words (cut to ``most``)."""
    at = np.arange(len(lengths))
    reach = lengths if most is None else np.minimum(lengths, most)
    return np.maximum.accumulate(np.where(lengths >= least, at + reach, 0)) > at if len(at) else at.astype(bool)


def measure(texts: list[str], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> dict:
    """The columns ``COLUMNS`` for a list of texts."""
    number: defaultdict = defaultdict(count().__next__)
    codes, sizes, word_chars, symbols, dup_lines = [], [], [], [], []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        sizes.append(len(words))
        codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        word_chars.append(len(text) - len(data) + len(data.translate(None, BLANKS)))
        symbols.append(len(data) - len(data.translate(None, SYMBOLS)))
        lines = [x for x in data.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    n = np.array(sizes, np.int64)
    bounds = np.r_[0, np.cumsum(n)]
    doc = np.repeat(np.arange(len(texts)), n)
    lengths = repeat_lengths(np.concatenate(codes) if codes else np.empty(0, np.int64), doc)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag)]
        return total[bounds[1:]] - total[bounds[:-1]]

    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, lengths)
    windows = per_doc(covered(lengths, WINDOW, WINDOW))
    spans = per_doc(covered(lengths, min_repeat))
    failed = (n < MIN_WORDS) | (100 * windows > 50 * n)
    kept = ~failed & (spans <= max_covered * n) & (longest <= max_repeat)
    return {
        "n_words": n, "word_chars": np.array(word_chars, np.int64), "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": windows, "base_failed": failed, "kept": kept,
        "covered_words": spans, "longest_repeat": longest,
    }


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: float) -> DataFrame:
    """Measures and verdict per row of ``docs``, in one pass without a shuffle.

    A null or empty text has no words and fails the base rule; repeated rows and null ids give a
    row each; other columns of ``docs`` are not read; an empty table gives no rows.
    """
    return map_texts(docs, [doc_id], text, COLUMNS, lambda: lambda texts: measure(texts, **limits))


def keep_good(docs: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, with all their columns."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in slices(texts):
                yield batch.slice(a, b - a).filter(pa.array(measure(texts[a:b], **limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
