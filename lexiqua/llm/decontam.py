"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame functions only.

Every word shingle of a document that some benchmark item holds anchors windows as long as those
items; a window without such a shingle has similarity 0, and moving a window right to its first
shared shingle never lowers its similarity, so the anchored windows include the best ones.  Each
window gets a 64-bit SimHash of its shingles.  Multi-index blocks find every item fingerprint
within the Hamming radius: of ``BLOCKS`` blocks at least one differs in at most
``RADIUS // BLOCKS`` bits, and the items are indexed under all such variants of each block.  The
weighted Jaccard similarity of the shingle multisets then verifies each candidate exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.staging import stage
from .common import WORD_BREAKS, unused

SHINGLE = 5
SIMILARITY = 0.75
#: Windows of similarity 0.75 differ in 11 of 64 bits on average (deviation 3), so a radius of 23
#: misses about one in ten thousand of those at the very threshold.
RADIUS, BLOCKS = 23, 8
BITS = 64 // BLOCKS
LANES = 32
LANE_MASK = (1 << LANES) + 1


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_BREAKS), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shingles(tokens: Column) -> Column:
    n = F.size(tokens)
    places = F.sequence(F.lit(1), n - (SHINGLE - 1))
    rolled = F.transform(places, lambda i: F.xxhash64(*[F.element_at(tokens, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, rolled).when(n > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<bigint>"))


def shingles(tokens: Column) -> Column:
    """Hashes of the five-word shingles in order; a shorter text is one shingle as a whole."""
    return bound(tokens, _shingles)


def lane_sums(h: Column) -> list[Column]:
    """Sums that count the set bits of hashes, two bit positions in each 64-bit sum."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANE_MASK))).alias(f"_l{j}") for j in range(LANES)]


def fingerprint(n: Column) -> Column:
    """The SimHash from the lane sums of ``n`` hashes: a bit is set if most hashes set it."""
    out = F.lit(0).cast("long")
    for j in range(LANES):
        low, high = F.col(f"_l{j}").bitwiseAND(F.lit((1 << LANES) - 1)), F.shiftrightunsigned(F.col(f"_l{j}"), LANES)
        for bit, ones in ((j, low), (j + LANES, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(2 * ones > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def block(fp: Column, b: Column | int) -> Column:
    places = b * BITS if isinstance(b, Column) else F.lit(b * BITS)
    return F.call_function("shiftrightunsigned", fp, places).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def variants() -> list[int]:
    """All changes of at most RADIUS // BLOCKS bits in one block."""
    return [sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS), r)]


def numbered(hashes: Column) -> Column:
    """Hashes made distinct by their occurrence, so that set operations count multiplicities."""
    again = bound(
        F.sort_array(hashes), lambda ordered: F.transform(ordered, lambda h, i: F.xxhash64(h, i - F.array_position(ordered, h).cast("int")))
    )
    plain = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(-1)))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), again).otherwise(plain)


def first_agreeing(a: Column, b: Column) -> Column:
    """The first block in which two fingerprints differ in few enough bits."""
    most = RADIUS // BLOCKS
    differ = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(F.bit_count(block(differ, i)) <= most, F.lit(i)) for i in range(BLOCKS)])


def leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each leaked pair.

    ``start`` counts words from 0; of equally similar windows the first counts.  A document that
    is shorter than an item is one window.  A text of fewer than five words is one shingle, so a
    short item matches only a document of just these words.  Null and empty texts match nothing;
    rows without ``doc_id`` are left out, as nothing could name them; repeated rows of a document
    give one row per item; other columns are not read; empty tables give no rows.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), words(text).alias("w"))
    items = items.select("item_id", F.size("w").alias("len"), shingles(F.col("w")).alias("item_shingles")).where("len > 0")
    items = stage(items.dropDuplicates(), "items")
    read = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    # anchors: places of shingles that items hold
    tokens = read.select("doc_id", words("text").alias("w")).select("doc_id", F.size("w").alias("n"), shingles(F.col("w")).alias("s"))
    placed = tokens.select("doc_id", "n", F.posexplode("s").alias("at", "h"))
    held = stage(items.select("len", F.explode("item_shingles").alias("h")).groupBy("h").agg(F.collect_set("len").alias("lens")), "held")
    anchors = lookup_join(placed, held, ["h"], ["doc_id", "at"])
    windows = anchors.select("doc_id", "n", "at", F.explode("lens").alias("len")).select(
        "doc_id", F.greatest(F.least("at", F.col("n") - F.col("len")), F.lit(0)).alias("start"), "len"
    )
    near = stage(windows.groupBy("doc_id").agg(F.collect_set(F.struct("start", "len")).alias("windows")), "near")
    suspects = lookup_join(read, near, ["doc_id"], ["doc_id"])
    suspects = stage(suspects.select("doc_id", "windows", shingles(words("text")).alias("s")), "suspects")

    def cut(start: Column, length: Column) -> Column:
        return F.slice("s", start + 1, F.greatest(length - (SHINGLE - 1), F.lit(1)))

    def hashed(df: DataFrame, keys: list[str], of: str) -> DataFrame:
        each = df.select(*keys, F.explode(of).alias("h"))
        sums = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *lane_sums(F.col("h")))
        return sums.select(*keys, fingerprint(F.col("_n")).alias("fp"))

    cuts = suspects.select(
        "doc_id", F.explode(F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["len"].alias("len"), cut(w["start"], w["len"]).alias("c")))).alias("x")
    ).select("doc_id", "x.*")
    prints = hashed(cuts, ["doc_id", "start", "len"], "c")
    index = hashed(items, ["item_id", "len"], "item_shingles").withColumnRenamed("fp", "item_fp")
    index = index.withColumn("b", F.explode(F.array(*[F.lit(i) for i in range(BLOCKS)])))
    index = index.withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in variants()])))
    index = index.withColumn("v", block(F.col("item_fp"), F.col("b")).bitwiseXOR(F.col("flip"))).drop("flip")
    index = stage(index, "index")
    probes = prints.withColumn("b", F.explode(F.array(*[F.lit(i) for i in range(BLOCKS)]))).withColumn("v", block(F.col("fp"), F.col("b")))
    found = lookup_join(probes, index, ["len", "b", "v"], ["doc_id", "start"])
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    candidates = found.where(close & (F.col("b") == first_agreeing(F.col("fp"), F.col("item_fp")))).select("doc_id", "start", "len", "item_id")
    per_doc = stage(candidates.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "item_id")).alias("c")), "candidates")

    # exact verification on the shingle multisets
    joined = lookup_join(suspects.select("doc_id", "s"), per_doc, ["doc_id"], ["doc_id"])
    pairs = joined.select(
        "doc_id", F.explode(F.transform("c", lambda c: F.struct(c["item_id"].alias("item_id"), c["start"].alias("start"), cut(c["start"], c["len"]).alias("s")))).alias("x")
    ).select("doc_id", "x.*")
    both = lookup_join(pairs, items.select("item_id", "len", "item_shingles"), ["item_id"], ["doc_id", "start"])
    shared = F.size(F.array_intersect(numbered(F.col("s")), numbered(F.col("item_shingles"))))
    union = F.size("s") + F.size("item_shingles") - shared
    scored = both.select("doc_id", "item_id", "start", "len", (shared / union).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "len")).alias("m"))
    return best.select(
        "doc_id", "item_id", F.round("m.similarity", 6).alias("similarity"), (-F.col("m.back")).cast("long").alias("start"), F.col("m.len").cast("long").alias("n_words")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item leaks, with all their columns."""
    key = unused(docs, "_leak")
    hit = stage(leaks(docs, benchmark, similarity, doc_id).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    flagged = lookup_join(docs.withColumn(key, F.col(doc_id)), hit.withColumn(f"{key}hit", F.lit(True)), [key], [key], "left")
    return flagged.where(F.col(f"{key}hit").isNull()).select(*docs.columns)


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS MATERIALIZED (
  SELECT doc_id, len(w) AS n, unnest(range(greatest(len(w) - 4, 1))) AS pos, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS h
  FROM dw WHERE len(w) > 0),
its AS MATERIALIZED (
  SELECT item_id, len(w) AS l, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS h
  FROM iw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT doc_id, item_id, l, greatest(least(pos, n - l), 0) AS start
  FROM ds JOIN its USING (h) WHERE (n >= 5) = (l >= 5)),
wc AS (
  SELECT item_id, l, doc_id, start, h, count(*) AS c FROM win JOIN ds USING (doc_id)
  WHERE pos BETWEEN start AND start + greatest(l - 5, 0) GROUP BY ALL),
wn AS (SELECT item_id, doc_id, start, l, sum(c) AS n FROM wc GROUP BY ALL),
ic AS (SELECT item_id, h, count(*) AS c FROM its GROUP BY ALL),
inn AS (SELECT item_id, count(*) AS n FROM its GROUP BY ALL),
common AS (SELECT wc.item_id, doc_id, start, sum(least(wc.c, ic.c)) AS m FROM wc JOIN ic USING (item_id, h) GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, start, l, m::DOUBLE / (wn.n + inn.n - m) AS s
  FROM common JOIN wn USING (item_id, doc_id, start) JOIN inn USING (item_id))
SELECT doc_id, item_id, round(max(s), 6) AS similarity, arg_max(start, (s, -start)) AS start, arg_max(l, (s, -start)) AS n_words
FROM scored WHERE s >= {SIMILARITY} GROUP BY doc_id, item_id"""
