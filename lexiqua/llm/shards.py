"""Shards of near equal bytes from a k-d tree over document metadata.

The tree is built over groups of equal texts, one row each after map-side aggregation; a group
above a small share of a shard is first cut into pieces by document id, so that neither one task
nor one shard has to take it whole.  Each level finds the widest dimension of every node from a
min-max aggregation and cuts the node at the weighted median along it.  A median comes from byte
sums per bucket: each round narrows every node's interval to the bucket that holds the cut, so
only one row per node and bucket is shuffled, and one row per node reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.ordering import row_positions
from ..plans.staging import stage

#: Buckets per node and round of a median.
BUCKETS = 256
#: A group of equal texts is cut only above this share of a shard, and never below the largest text.
GRAIN = 64
#: Coordinates are integers below this; one round narrows an interval BUCKETS-fold.
SPAN = 1 << 24
ROUNDS = 3


def metadata(docs: DataFrame, doc_id: str, text: str, lang: str | None, source: str | None) -> DataFrame:
    """(doc_id, size, crc, h1, h2, lang, source) of every row; the text itself goes no further."""
    content = F.coalesce(text, F.lit(""))
    named = {n: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")) for n, c in (("lang", lang), ("source", source))}
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h1"),
        F.hash(text, F.lit(7)).alias("h2"),
        *[v.alias(n) for n, v in named.items()],
    )


def _scaled(value: Column, low: float, high: float) -> Column:
    return F.least(F.floor((value - low) * ((SPAN - 1) / max(high - low, 1e-9))), F.lit(SPAN - 1)).cast("long")


def atoms(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their piece number, and one row per (text, piece) with bytes and coordinates.

    Dimensions: logarithm of the size, language and source (hashed to the range), smallest id.
    """
    total = rows.agg(F.sum("size").alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("size").alias("m")).first()
    grain = max(1, total["m"] or 1, (total["b"] or 0) // (shards * GRAIN))
    heavy = stage(
        rows.groupBy("h1", "h2").agg(F.sum("size").alias("b")).where(F.col("b") > grain).select("h1", "h2", F.ceil(F.col("b") / grain).cast("int").alias("pieces")),
        "heavy",
    )
    cut = lookup_join(rows, heavy, ["h1", "h2"], ["doc_id"], "left")
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("int")
    placed = stage(cut.select("doc_id", "size", "crc", "h1", "h2", piece.alias("piece"), "lang", "source"), "pieces")
    groups = placed.groupBy("h1", "h2", "piece").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("first")
    )
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(SPAN)).cast("long")
    tie = F.pmod(F.xxhash64("h1", "h2", "piece"), F.lit(SPAN)).cast("long")
    lo, hi = float(total["lo"] or 0), float(total["hi"] or 0)
    made = groups.select(
        "h1", "h2", "piece", "bytes",
        _scaled(F.log(F.col("size").cast("double")), 0.0, math.log(max(total["m"] or 1, 2))).alias("d0"),
        _scaled(F.coalesce(F.col("first"), F.lit(lo)).cast("double"), lo, hi).alias("d1"),
        hashed("source").alias("d2"), hashed("lang").alias("d3"), tie.alias("tie"),
    )
    return placed, stage(made, "atoms")


DIMENSIONS = ("d0", "d1", "d2", "d3")


def _cuts(points: DataFrame, wanted: dict[int, float], place: Column) -> dict[int, tuple[int, float, int]]:
    """For every node the coordinate at which the running bytes pass ``wanted``, the bytes still
    wanted from the rows at that very coordinate, and the bytes that these rows have."""
    low = {n: 0 for n in wanted}
    rest, here = dict(wanted), {n: 0 for n in wanted}
    width = SPAN
    for _ in range(ROUNDS):
        step = max(1, width // BUCKETS)
        start = _lookup(low, F.col("node"))
        bucket = F.floor((place - start) / step)
        counted = (
            points.withColumn("at", place)
            .where((F.col("at") >= start) & (F.col("at") < start + width))
            .groupBy("node", bucket.alias("bucket"))
            .agg(F.sum("bytes").alias("b"))
        )
        order = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        upto = counted.withColumn("upto", F.sum("b").over(order))
        found = upto.where(F.col("upto") >= _lookup(rest, F.col("node")))
        first = found.groupBy("node").agg(F.min(F.struct("bucket", "upto", "b")).alias("f"))
        for row in first.collect():  # one row per node, as many as shards at most
            low[row["node"]] += row["f"]["bucket"] * step
            rest[row["node"]] -= row["f"]["upto"] - row["f"]["b"]
            here[row["node"]] = row["f"]["b"]
        width = step
    return {n: (low[n], rest[n], here[n]) for n in wanted}


def _lookup(values: dict[int, float], key: Column) -> Column:
    """The value of each node (a literal map of at most as many entries as shards)."""
    return F.element_at(F.create_map(*[F.lit(x) for n, v in values.items() for x in (n, v)]), key)


def tree(points: DataFrame, shards: int) -> DataFrame:
    """(h1, h2, piece, shard): the leaf of every atom; leaf sizes are near the same bytes.

    A node for ``k`` shards is cut at the share ``k // 2`` of ``k`` along its widest dimension, and
    among equal coordinates by a hash of the atom, until every node is one shard.
    """
    nodes = {0: (0, shards)}  # node -> (first shard, shards)
    current = points.withColumn("node", F.lit(0))
    while any(k > 1 for _, k in nodes.values()):
        stats = {
            r["node"]: r
            for r in current.groupBy("node")
            .agg(F.sum("bytes").alias("b"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS])
            .collect()
        }
        open_ = {n: k for n, (_, k) in nodes.items() if k > 1 and n in stats}
        if not open_:
            break
        axis = {n: max(range(len(DIMENSIONS)), key=lambda i: (stats[n][DIMENSIONS[i]], -i)) for n in open_}
        place = F.element_at(F.array(*DIMENSIONS), _lookup(axis, F.col("node")) + 1)
        inside = current.where(F.col("node").isin(*open_))
        wanted = {n: stats[n]["b"] * (k // 2) / k for n, k in open_.items()}
        cuts = _cuts(inside, wanted, place)
        at = _lookup({n: c for n, (c, _, _) in cuts.items()}, F.col("node"))
        equal = inside.where(place == at)
        ties = _cuts(equal, {n: r for n, (_, r, _) in cuts.items()}, F.col("tie"))
        # the atom at the cut goes left if that comes nearer to the wanted bytes
        tie_at = _lookup({n: c - (2 * r < b) for n, (c, r, b) in ties.items()}, F.col("node"))
        right = (place > at) | ((place == at) & (F.col("tie") > tie_at))
        child = F.when(F.col("node").isin(*open_), F.col("node") * 2 + 1 + right.cast("int")).otherwise(F.col("node"))
        current = stage(current.withColumn("node", child), "tree")
        nodes = {n: v for n, v in nodes.items() if n not in open_} | {
            c: v for n in open_ for f, k in [nodes[n]] for c, v in ((2 * n + 1, (f, k // 2)), (2 * n + 2, (f + k // 2, k - k // 2)))
        }
    return current.select("h1", "h2", "piece", _lookup({n: f for n, (f, _) in nodes.items()}, F.col("node")).cast("int").alias("shard"))


def kd_shards(
    docs: DataFrame, shards: int = 8, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text",
    lang: str | None = "lang", source: str | None = "source",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; ``target_bytes`` sets the number of
    shards from the total.  Rows with equal texts share a shard unless their group is larger than
    1/64 of one and than the largest text.  ``slot`` numbers a shard's rows from 0 by id.  Null ids, languages and sources
    are values of their own; repeated rows keep a row each; an empty table gives no rows.
    """
    rows = stage(metadata(docs, doc_id, text, lang, source), "metadata")
    if target_bytes:
        shards = max(1, round((rows.agg(F.sum("size").alias("b")).first()["b"] or 0) / target_bytes))
    placed, points = atoms(rows, shards)
    leaves = stage(tree(points, shards), "leaves")
    # an atom has few rows, so this join needs no salt
    joined = placed.join(leaves, ["h1", "h2", "piece"]).select("doc_id", "size", "crc", "shard")
    numbered = row_positions(joined, ["shard"], [F.col("doc_id").asc(), F.col("size").asc(), F.col("crc").asc()], "slot")
    return numbered.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
