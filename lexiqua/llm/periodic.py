"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period q, at least ``least`` words and ``power`` periods
long, that no neighbouring word extends.  Every operation works on a slice of documents at once:

1. Harmonic grid: for each period p, a run has at least g = max(least - p, (power - 1) p)
   consecutive positions i with word i equal to word i + p, so one of them is a multiple of g.
   Over all p that is n log n comparisons.  Grid points keep those whose neighbours on one side
   agree as well, as they do inside every run.
2. Run-length grammar over the documents that have grid points: block compression replaces
   maximal repetitions of one symbol, pair compression then replaces the pairs of a random left
   and right symbol, in turns, until one symbol per document is left.  Equal stretches get equal
   symbols but for a bounded number at their ends.
3. Longest common extensions: two positions climb the grammar while both begin a symbol, passing
   the few symbols at the borders, and descend from the first difference.  The extensions of
   (i, i + p) to the right and (mirrored) to the left are the run.  Of equal stretches the smallest
   period stays, as larger ones are its multiples.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BREAKS, map_texts

LEAST, POWER = 24, 3


@dataclass
class Level:
    """Symbols of one level; ``up`` is the place of each one's parent on the next level, ``first``
    and ``last`` are the outer children of each parent.  In ``blocks`` a parent's children are
    equal."""

    symbols: np.ndarray
    up: np.ndarray | None = None
    first: np.ndarray | None = None
    last: np.ndarray | None = None
    blocks: bool = False

    def join(self, begins: np.ndarray, blocks: bool) -> None:
        """Parents begin where ``begins`` is true."""
        self.up = np.cumsum(begins) - 1
        self.first = np.flatnonzero(begins)
        self.last = np.r_[self.first[1:], len(begins)] - 1
        self.blocks = blocks

    def mirrored(self, above: int) -> Level:
        """The same level read from right to left; ``above`` is the size of the next level."""
        out = Level(self.symbols[::-1], blocks=self.blocks)
        if self.up is not None:
            size = len(self.symbols)
            out.up = above - 1 - self.up[::-1]
            out.first, out.last = size - 1 - self.last[::-1], size - 1 - self.first[::-1]
        return out


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense names of the pairs (left, right) of non-negative numbers."""
    return np.unique(left * (np.int64(right.max()) + 1) + right, return_inverse=True)[1]


def grammar(words: np.ndarray, ends: int, seed: int = 1) -> list[Level]:
    """Levels above ``words``, in which the ``ends`` separators occur once each and have the
    largest numbers.  Separators join nothing."""
    random = np.random.default_rng(seed)
    level, levels = Level(words), []
    fixed = words >= words.max() + 1 - ends
    while len(level.symbols) > 2 * ends - 1:
        s = level.symbols
        level.join(np.r_[True, s[1:] != s[:-1]], blocks=True)
        levels.append(level)
        fixed = fixed[level.first]
        s = _named(s[level.first], level.last - level.first)
        level = Level(s)
        left = random.integers(0, 2, s.max() + 1, dtype=np.int8).astype(bool)[s]
        begins = np.ones(len(s), bool)
        begins[1:] = ~(left[:-1] & ~left[1:]) | fixed[:-1] | fixed[1:]
        level.join(begins, blocks=False)
        levels.append(level)
        fixed = fixed[level.first]
        level = Level(_named(s[level.first], np.where(level.last > level.first, s[level.last] + 1, 0)))
    return [*levels, level]


def mirror(levels: list[Level]) -> list[Level]:
    sizes = [len(level.symbols) for level in levels]
    return [level.mirrored(above) for level, above in zip(levels, [*sizes[1:], 0])]


def _pass_equal(level: Level, a: np.ndarray, b: np.ndarray, which: np.ndarray) -> None:
    """Move the pairs ``which``, whose symbols are equal, behind them; equal blocks count as one."""
    step = 1
    if level.blocks:
        x, y = a[which], b[which]
        step = np.minimum(level.last[level.up[x]] - x, level.last[level.up[y]] - y) + 1
    a[which] += step
    b[which] += step


def common_extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of equal words from places i and j on, where i <> j."""
    a, b = i.copy(), j.copy()
    reached = np.full(len(a), len(levels) - 1)
    climbing = np.arange(len(a))
    for depth, level in enumerate(levels[:-1]):
        waiting, climbing = climbing, []
        while len(waiting):
            x, y = a[waiting], b[waiting]
            begin = (level.first[level.up[x]] == x) & (level.first[level.up[y]] == y)
            same = level.symbols[x] == level.symbols[y]
            climbing.append(waiting[begin])
            reached[waiting[~begin & ~same]] = depth
            waiting = waiting[~begin & same]
            _pass_equal(level, a, b, waiting)
        climbing = np.concatenate(climbing) if climbing else np.empty(0, np.int64)
        a[climbing], b[climbing] = level.up[a[climbing]], level.up[b[climbing]]
    descending = np.empty(0, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        descending = np.r_[descending, np.flatnonzero(reached == depth)]
        same = descending
        while len(same := same[level.symbols[a[same]] == level.symbols[b[same]]]):
            _pass_equal(level, a, b, same)
        if depth:
            below = levels[depth - 1].first
            a[descending], b[descending] = below[a[descending]], below[b[descending]]
    return a - i


def grid_points(words: np.ndarray, document: np.ndarray, lengths: list[int], least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, p) with word i equal to word i + p, among them one inside every run.

    ``words`` holds the documents from the longest to the shortest, each ended by a separator.
    """
    reach = max(min(max(least - p, (power - 1) * p) for p in range(1, least + 1)) // 2 - 1, 0)
    ends = np.cumsum(np.asarray(lengths, np.int64) + 1)
    falling = -np.asarray(lengths, np.int64)
    places, periods = [], []
    for p in range(1, (lengths[0] if lengths else 0) // power + 1):
        documents = np.searchsorted(falling, -max(least, power * p), "right")
        if not documents:
            break
        end, step = ends[documents - 1], max(least - p, (power - 1) * p)
        found = np.flatnonzero(words[: end - p : step] == words[p:end:step]) * step
        if len(found):
            places.append(found)
            periods.append(np.full(len(found), p))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, p = np.concatenate(places), np.concatenate(periods)
    keep = document[i] == document[i + p]
    i, p = i[keep], p[keep]
    last = len(words) - 1
    before, after = np.ones(len(i), bool), np.ones(len(i), bool)
    for k in range(1, reach + 1):
        after &= words[np.minimum(i + k, last)] == words[np.minimum(i + p + k, last)]
        before &= words[np.maximum(i - k, 0)] == words[np.maximum(i + p - k, 0)]
    keep = before | after
    return i[keep], p[keep]


def find_runs(texts: list[np.ndarray], least: int = LEAST, power: int = POWER) -> list[np.ndarray]:
    """For each array of word numbers its runs as rows (start, length, period), sorted."""
    order = sorted((k for k in range(len(texts)) if len(texts[k]) >= least), key=lambda k: -len(texts[k]))
    out = [np.empty((0, 3), np.int64)] * len(texts)

    def joined(which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = max((int(texts[k].max()) for k in which), default=0) + 1
        parts = [x for n, k in enumerate(which) for x in (texts[k], np.array([top + 1 + n]))]
        sizes = np.array([len(texts[k]) + 1 for k in which], np.int64)
        return np.concatenate(parts), np.repeat(np.arange(len(which)), sizes), np.cumsum(sizes) - sizes

    if not order:
        return out
    words, document, begins = joined(order)
    i, p = grid_points(words, document, [len(texts[k]) for k in order], least, power)
    if not len(i):
        return out
    chosen = np.unique(document[i])
    at = document[i]
    order = [order[k] for k in chosen]
    offset = i - begins[at]
    words, _, begins = joined(order)
    # a separator before the first document, so that extensions to the left end too
    words = np.r_[words.max() + 1, words]
    at = np.searchsorted(chosen, at)
    i = offset + begins[at] + 1
    levels = grammar(words, len(order) + 1)
    right = common_extensions(levels, i, i + p)
    back = len(words) - 1
    left = common_extensions(mirror(levels), back - (i - 1), back - (i + p - 1))
    length = left + p + right
    keep = length >= np.maximum(least, power * p)
    rows = np.unique(np.stack([at[keep], (i - left - 1 - begins[at])[keep], length[keep], p[keep]], axis=1), axis=0)
    # of one stretch the smallest period comes first
    if len(rows):
        rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for k, part in zip(np.unique(rows[:, 0]), np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1)):
        out[order[k]] = part[:, 1:]
    return out


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
)


def _scan(least: int, power: int):
    def scan(texts: list[str]) -> dict:
        number: defaultdict = defaultdict(count().__next__)
        rows = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        codes = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in rows]
        out: dict[str, list] = {"n_words": [len(words) for words in rows], "runs": [], "collapsed": []}
        for words, runs in zip(rows, find_runs(codes, least, power)):
            if len(runs):
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
                np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
            out["collapsed"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return out

    return scan


def periodic_runs(
    docs: DataFrame, least: int = LEAST, power: int = POWER, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of ``docs``, repeated rows and null ids too.

    ``runs`` are (start, length, period) by start, then period; starts are word numbers from 0.
    ``collapsed`` is the text with one space between words and without those that a run holds after
    its first period.  Null and empty texts have no words, no runs and an empty ``collapsed``; an
    empty table gives no rows; other columns are not read.  Texts are processed whole, each in one
    task, in memory of a small multiple of its size.
    """
    if least < 2 or power < 2:
        raise ValueError("runs have at least two words and two periods")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(texts, ["doc_id"], "text", FOUND, lambda: _scan(least, power))


def with_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of all rows; a tenth of the ids, chosen by their CRC, end in a repeated stretch.

    Rows without an id or without words stay as they are.
    """
    words = F.expr(rf"filter(split(text, '{WORD_BREAKS}'), w -> w <> '')".replace("\\", "\\\\"))
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "h", F.crc32(F.col("doc_id").cast("string").cast("binary"))
    )
    picked = hashed.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    a = g % F.col("n")
    placed = picked.withColumn("a", a.cast("int")).withColumn("p", (1 + F.floor((F.col("n") - a) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def _strongest() -> Column:
    """The run of greatest length / period, the first of equal ones."""
    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate("runs", F.lit(None).cast(RUN), better)


def digests(found: DataFrame) -> DataFrame:
    """The figures of every document's runs."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ended = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    best = found.withColumn("best", _strongest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(ended, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of a string, bit by bit: 256 stands for one shift.
_CRC = (
    "xor(list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii({0}[i])::BIGINT] || list_transform(range(8), lambda k: 256::BIGINT))), "
    "lambda c, b: CASE WHEN b < 256 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)"
)
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  CASE WHEN doc_id IS NOT NULL THEN {_CRC.format("(doc_id::VARCHAR)")} END AS h, row_number() OVER () AS row FROM documents),
e AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM d),
t AS MATERIALIZED (SELECT row, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS w FROM e),
p AS MATERIALIZED (SELECT row, n, unnest(w) AS w, unnest(range(n)) AS i FROM t),
eq AS (SELECT x.row, y.i - x.i AS q, x.i FROM p x JOIN p y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isl AS (SELECT row, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS grp FROM eq) GROUP BY row, q, grp),
runs AS MATERIALIZED (SELECT row, start, length, min(q) AS period FROM isl WHERE length >= greatest(24, 3 * q) GROUP BY row, start, length),
best AS (SELECT row, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY row),
top AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.row = r.row AND (o.length * r.period > r.length * o.period
  OR o.length * r.period = r.length * o.period AND (o.start, o.period) < (r.start, r.period)))),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT p.row, sha256(string_agg(p.w, ' ' ORDER BY p.i)) AS c FROM p LEFT JOIN gone ON gone.row = p.row AND gone.i = p.i WHERE gone.i IS NULL GROUP BY p.row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(c, sha256('')) AS collapsed_sha256
FROM t LEFT JOIN best USING (row) LEFT JOIN top USING (row) LEFT JOIN kept USING (row)"""
