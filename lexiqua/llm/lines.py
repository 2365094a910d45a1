"""Removal of boilerplate lines by the number of distinct sites that carry them.

One aggregation per line hash merges HyperLogLog sketches of the sites, map-side first, so a line
that a third of all rows hold reaches one task as a few sketches.  Only lines whose estimate lies
near the threshold get an exact distinct count.  A boilerplate line stays at its first place
(smallest document id, then line number) and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.staging import stage
from .common import WORD_BREAKS, unused

#: Lines on so many distinct sites are boilerplate.
MIN_SITES = 8
#: log2 of a sketch's buckets; estimates within this share of the threshold are counted exactly.
BUCKETS, NEAR = 12, 0.1

KEY = ["h1", "h2"]


def site_lines(docs: DataFrame, doc_id: str, text: str, site: str, min_words: int = 1) -> DataFrame:
    """(doc_id, site, line_no, h1, h2): the lines with ``min_words`` words, at least one, trimmed and hashed to 96 bits."""
    lines = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )
    bare = lines.withColumn("line", F.regexp_replace("line", rf"^{WORD_BREAKS}|{WORD_BREAKS}$", ""))
    if min_words > 1:
        bare = bare.where(F.size(F.split("line", WORD_BREAKS)) >= min_words)
    return bare.where((F.col("line") != "") & F.col("doc_id").isNotNull()).select(
        "doc_id", "site", "line_no", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first): the lines on at least ``min_sites`` sites and their first place."""
    spread = lines.groupBy(*KEY).agg(
        F.hll_sketch_agg("site", F.lit(BUCKETS)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first")
    )
    guessed = stage(
        spread.where(F.col("n") >= min_sites)
        .select(*KEY, "first", F.hll_sketch_estimate("sketch").alias("guess"))
        .where(F.col("guess") >= min(min_sites - 1, min_sites * (1 - NEAR))),
        "spread",
    )
    sure = F.col("guess") > max(min_sites + 1, min_sites * (1 + NEAR))
    unsure = guessed.where(~sure).select(*KEY)
    exact = (
        lookup_join(lines, unsure, KEY, ["doc_id"]).groupBy(*KEY).agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return guessed.where(sure).select(*KEY, "first").unionByName(guessed.join(exact, KEY).select(*KEY, "first"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_words: int = 1) -> DataFrame:
    """(doc_id, gone): for documents that lose lines, the numbers of these, from 0."""
    lines = stage(site_lines(docs, doc_id, text, site, min_words), "lines")
    found = stage(boilerplate(lines, min_sites), "boilerplate")
    hits = lookup_join(lines, found, KEY, ["doc_id"])
    later = hits.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no")))
    return later.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))


def without_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    chars: str | None = None,
    keep_emptied: bool = True,
    min_words: int = 1,
) -> DataFrame:
    """``docs`` with the lines removed; ``chars``, if named, gets the new text's length.

    Lines of fewer than ``min_words`` words always stay.  All rows stay, also those left without a line.  With ``keep_emptied=False`` a row goes if it
    lost every line that had a word; each of these stays at its first place in another row.  Rows
    that never had a word stay in either case.  A null text stays null, a null site counts as
    one site without name, rows without ``doc_id`` stay as they are.  Rows that repeat an id lose
    the same line numbers.  Other columns pass through; an empty table gives an empty one.
    """
    gone, key = unused(docs, "_gone"), unused(docs, "_key")
    found = removals(docs, min_sites, doc_id, text, site, min_words).select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    joined = lookup_join(docs.withColumn(key, F.col(doc_id)), stage(found, "gone"), [key], [text], "left")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    if not keep_emptied:
        # lines in "gone" had a word, so such a row had one
        joined = joined.where(F.col(gone).isNull() | F.exists(kept, lambda line: F.regexp_replace(line, WORD_BREAKS, "") != ""))
    columns = {text: cleaned, **({chars: F.length(cleaned).cast(docs.schema[chars].dataType)} if chars else {})}
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def digests(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_chars, clean_sha256): length and digest of every cleaned text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    clean = without_boilerplate(docs.select("doc_id", "text", "source"), min_sites)
    return clean.select("doc_id", F.length(text).cast("long").alias("clean_chars"), F.sha2(text, 256).alias("clean_sha256"))


_BARE = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
SQL = f"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS site, line, {_BARE} AS bare, i AS line_no FROM (
    SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
common AS (
  SELECT bare, min(struct_pack(d := doc_id, l := line_no)) AS first FROM lines WHERE bare <> ''
  GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
clean AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no)
      FILTER (first IS NULL OR (first.d = doc_id AND first.l = line_no)), '') AS text
  FROM lines LEFT JOIN common USING (bare) GROUP BY doc_id)
SELECT doc_id, length(text) AS clean_chars, sha256(text) AS clean_sha256 FROM clean"""
