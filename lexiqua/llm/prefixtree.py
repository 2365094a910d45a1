"""N-gram Jaccard join over prefix trees.

1. Documents with equal shingle sets are one class, whose smallest id takes part.
2. A shingle in no other class matches nothing, and a document with more than n - ceil(t n) of
   those cannot link.  Shingles below a fixed hash bound, the same for all documents, settle that
   for most of them without moving the rest; whole sets are compared for what is left.
3. The shingles that others hold too are ordered by rarity.  Sets of similarity t have their first
   common shingle among the first n - ceil(t n) + 1 of either, those without a match counted
   first.  The part of a set from one of these on is a path below the root branch of that shingle.
4. A branch is a group of paths.  They are sorted into a trie, whose nodes are passed once for all
   documents of the group at the same time: a node adds its stretch of shingles to the overlaps so
   far, documents leave as soon as what remains of either side cannot suffice, or when all that is
   below the node belongs to their component already.  What reaches an end is compared exactly.
5. First every document goes below its first branch only.  That joins most groups of near copies.
   Then the branches whose documents are still in different components are passed in full,
   branches with common documents together.  Large branches are cut into parts of bounded weight,
   and parts of different components meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import lookup_join, small_side
from ..plans.staging import stage
from .common import map_texts
from .neardup import components, shingle_sets

PERCENT = 80
#: Shingles with a hash below this share of all settle who can link at all.
SHARE = 3
#: Shingles of a part of a branch; a document counts as so many more.
WEIGHT, EACH = 300_000, 200
#: Holders of one shingle that a join leaves in one task.
HOT = 250_000

SKETCH = T.StructType(
    [T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("low", T.ArrayType(T.LongType()))]
)
SET = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("s", T.ArrayType(T.LongType()))])


def _digest(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch(texts: list[str]) -> dict:
    bound = np.uint64(2**64 // SHARE)
    out: dict[str, list] = {"digest": [], "n": [], "low": []}
    for _, s in shingle_sets(texts):
        out["digest"].append(_digest(s))
        out["n"].append(len(s))
        out["low"].append(s[: np.searchsorted(s, bound)].view(np.int64))
    return out


def _sets(texts: list[str]) -> dict:
    sets = [s for _, s in shingle_sets(texts)]
    return {"digest": [_digest(s) for s in sets], "s": [s.view(np.int64) for s in sets]}


def _spare(percent: int, n: str = "n") -> Column:
    """How many shingles of a set may lack a match."""
    return F.col(n) - F.ceil(F.col(n) * percent / 100)


# ------------------------------------------------------------------ one group

def tree_links(paths: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (x, y) that join the components of a group as far as its similar sets do.

    ``paths`` are ascending arrays of numbers, ``sizes`` the sizes of the whole sets, of which the
    paths hold all that any two have in common.  Only pairs from different components are returned,
    and no more than it takes to join them.
    """
    lengths = np.array([len(p) for p in paths])
    names, flat = np.unique(np.concatenate(paths), return_inverse=True)
    rows = np.split(flat, np.cumsum(lengths)[:-1])
    order = sorted(range(len(rows)), key=lambda k: rows[k].astype(">u4").tobytes())
    rows = [rows[k] for k in order]
    lengths, sizes = lengths[order], sizes[order]
    component = np.unique(component, return_inverse=True)[1][order]
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), lengths)
    start = np.cumsum(lengths) - lengths
    # who holds each shingle, and each row's shingles behind a given one
    by_name = np.argsort(flat, kind="stable")
    holders, bounds = owner[by_name], np.searchsorted(flat[by_name], np.arange(len(names) + 1))
    places = owner * np.int64(len(names)) + flat
    shared = [_shared(a, b) for a, b in zip(rows, rows[1:])]
    found = []
    stack = [(0, len(rows), 0, np.arange(len(rows)), np.zeros(len(rows), np.int64))]
    while stack:
        low, high, depth, open_, overlap = stack.pop()
        inside = component[low:high]
        keep = open_ < high - 1
        if (inside == inside[0]).all():
            keep &= component[open_] != inside[0]
        open_, overlap = open_[keep], overlap[keep]
        if not len(open_):
            continue
        deep = min(shared[low : high - 1], default=lengths[low])
        if deep > depth:
            stretch = rows[low][depth:deep]
            held = [holders[bounds[t] : bounds[t + 1]] for t in stretch]
            overlap = overlap + np.bincount(np.concatenate(held), minlength=len(rows))[open_]
            last = stretch[-1]
            behind = lengths[open_] - (np.searchsorted(places, open_ * np.int64(len(names)) + last, "right") - start[open_])
            most = overlap + np.minimum(behind, lengths[low:high].max() - deep)
            keep = (100 + percent) * most >= percent * (sizes[open_] + sizes[low:high].min())
            open_, overlap = open_[keep], overlap[keep]
        end = low
        while end < high and lengths[end] == deep:
            linked = (open_ < end) & ((100 + percent) * overlap >= percent * (sizes[open_] + sizes[end])) & (component[open_] != component[end])
            for x in open_[linked]:
                if component[x] != component[end]:
                    found.append((order[x], order[end]))
                    component[component == component[x]] = component[end]
            end += 1
        if end < high and len(open_):
            cuts = [end, *[k + 1 for k in range(end, high - 1) if shared[k] == deep], high]
            stack += [(a, b, deep, open_, overlap) for a, b in zip(cuts, cuts[1:])][::-1]
    return found


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _group_links(paths: DataFrame, percent: int) -> DataFrame:
    """(x, y): links within the groups (key, part) of paths (doc_id, n, component, path)."""
    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.array([r[0] for r in rows])
        made = tree_links([r[3] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), percent)
        if made:
            x, y = ids[np.array(made)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1)
            columns = [batch.column(c).to_numpy() for c in (2, 3, 4)]
            lists = batch.column(5)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]) if len(keys) else ():
                if group != tuple(keys[a]):
                    if len(rows) > 1:
                        yield from links(rows)
                    group, rows = tuple(keys[a]), []
                rows += [(*(c[k] for c in columns), values[offsets[k] : offsets[k + 1]].copy()) for k in range(a, b)]
        if len(rows) > 1:
            yield from links(rows)

    sent = paths.select("key", "part", "doc_id", "n", "component", "path")
    return sent.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "x long, y long")


# ------------------------------------------------------------------ groups

def _first_branches(sets: DataFrame) -> DataFrame:
    """Every document below its first branch.  Of a branch in several parts each has the document
    with the most common beginning in it, so that parts are joined through it."""
    rows = sets.select(F.col("path")[0].alias("key"), "doc_id", "n", F.col("doc_id").alias("component"), "path")
    size = F.sum(F.size("path") + EACH)
    hub = F.min(F.struct(F.col("n") - F.size("path"), "doc_id"))
    branches = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.ceil(size / WEIGHT).cast("int").alias("parts"), hub["doc_id"].alias("hub"))
    branches = stage(branches.where("m > 1").drop("m"), "branches")
    found = lookup_join(rows, branches, ["key"], ["doc_id"])
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    parts = F.when(F.col("doc_id") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    return found.select("key", F.explode(parts).alias("part"), "doc_id", "n", "component", "path")


def _open_branches(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Groups that hold every document of a branch with several components.

    Branches with common documents form clusters.  A cluster within the weight of a part is one
    group, in which each document stands once with its whole path.  In larger clusters every branch
    is a group of its own.
    """
    named = lookup_join(sets, labels, ["doc_id"], ["doc_id"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = stage(named.select("doc_id", "n", "component", "path", F.size("path").alias("size")), "named")
    first = F.expr("slice(path, 1, spare + 1 - (n - size))")
    spread = named.withColumn("spare", _spare(percent).cast("int")).select("doc_id", "component", "size", F.posexplode(first).alias("at", "key"))
    spans = spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("one"))
    open_ = stage(spans.where("lo <> hi").select("key", "one"), "open")
    members = stage(lookup_join(spread, open_, ["key"], ["doc_id"]), "members")
    touch = members.where("doc_id <> one").select(F.col("one").alias("x"), F.col("doc_id").alias("y")).distinct()
    clusters = components(stage(touch, "touch")).withColumnRenamed("component", "cluster")
    sizes = lookup_join(named.select("doc_id", "size"), clusters, ["doc_id"], ["doc_id"])
    weights = stage(sizes.groupBy("cluster").agg(F.sum(F.col("size") + EACH).alias("w")), "weights")
    dealt = stage(lookup_join(clusters, weights, ["cluster"], ["doc_id"]).select("doc_id", "cluster", (F.col("w") <= WEIGHT).alias("whole")), "clusters")
    whole = lookup_join(named, stage(dealt.where("whole"), "whole"), ["doc_id"], ["doc_id"])
    groups = whole.select(F.col("cluster").alias("key"), F.lit(-1).alias("part"), "doc_id", "n", "component", "path")
    large = stage(dealt.where("NOT whole").select("doc_id"), "large")
    return groups if large.isEmpty() else groups.union(_parts(named, lookup_join(members, large, ["doc_id"], ["key"])))


def _parts(named: DataFrame, members: DataFrame) -> DataFrame:
    """Every document below its branches (key), from their place in its path on.

    The documents of a branch's largest component and the others are dealt into parts by weight.
    Parts of others meet all parts, those of the largest component only parts of others.
    """
    each = members.groupBy("key", "component").agg(F.sum(F.col("size") - F.col("at") + EACH).alias("w"))
    sums = each.groupBy("key").agg(F.sum("w").alias("w"), F.max(F.struct("w", "component")).alias("top"))
    others = F.ceil((F.col("w") - F.col("top.w")) / WEIGHT)
    plans = sums.select(
        "key", F.col("top.component").alias("top"), F.when(F.col("w") <= WEIGHT, 0).otherwise(others).cast("int").alias("others"),
        F.ceil(F.col("top.w") / WEIGHT).cast("int").alias("tops"),
    )
    found = lookup_join(members, stage(plans, "plans"), ["key"], ["doc_id"])
    deal = F.when(F.col("component") == F.col("top"), F.col("tops")).otherwise(F.col("others"))
    found = found.withColumn("mine", F.when(F.col("others") > 0, F.pmod(F.xxhash64("doc_id"), deal)).cast("int"))
    # part numbers: a pair of others' parts i <= j is i * others + j, others' part i with top part k is others^2 + i * tops + k
    of_top = F.expr("transform(sequence(0, others - 1), i -> others * others + i * tops + mine)")
    of_other = F.expr(
        "concat(transform(sequence(0, others - 1), j -> least(mine, j) * others + greatest(mine, j)), "
        "transform(sequence(0, tops - 1), k -> others * others + mine * tops + k))"
    )
    parts = F.when(F.col("others") == 0, F.array(F.lit(0))).when(F.col("component") == F.col("top"), of_top).otherwise(of_other)
    groups = found.select("key", "at", "doc_id", F.explode(parts).alias("part"))
    with_paths = lookup_join(groups, named.select("doc_id", "n", "component", "path"), ["doc_id"], ["key", "part"])
    return with_paths.select("key", "part", "doc_id", "n", "component", F.expr("slice(path, at + 1, size(path))").alias("path"))


def _held_elsewhere(rows: DataFrame, row: list[str]) -> DataFrame:
    """The rows (``row``, key) whose key others hold too, with the number of holders ``f``.

    Counting and joining shuffle by key at every size.  A key of very many holders is split by row,
    and its count copied; how many parts it takes the counts say already.
    """
    often = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    hot = stage(often.where(F.col("f") > HOT).select("key", F.ceil(F.col("f") / HOT).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        return rows.join(often.hint("shuffle_hash"), "key")
    hot = small_side(hot)
    split = rows.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64(*row), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = often.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return split.join(copies.hint("shuffle_hash"), ["key", "salt"]).drop("salt")


def _paths(texts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, path) of the documents that can link: their shingles that others hold, by rarity."""
    row = ["doc_id", "digest"]
    matched = _held_elsewhere(classes.select(*row, F.explode("low").alias("key")), row).groupBy(*row).agg(F.count(F.lit(1)).alias("matched"))
    sizes = classes.select(*row, F.col("n").alias("size"), F.size("low").alias("low"))
    left = sizes.join(matched, row, "left").where(F.col("low") - F.coalesce("matched", F.lit(0)) <= _spare(percent, "size"))
    alive = stage(left.select("doc_id").distinct(), "alive")
    sets = stage(map_texts(lookup_join(texts, alive, ["doc_id"], ["doc_id"]), ["doc_id"], "text", SET, lambda: _sets), "sets")
    each = sets.select(*row, F.size("s").cast("long").alias("n"), F.explode("s").alias("key"))
    # the class of rarity (powers of two) above 59 bits of the hash: one number to sort by
    rank = F.shiftleft(F.least(F.floor(F.log2("f")), F.lit(15)).cast("long"), 59).bitwiseOR(F.shiftrightunsigned("key", 5))
    held = _held_elsewhere(each, row).groupBy(*row).agg(F.first("n").alias("n"), F.sort_array(F.collect_set(rank)).alias("path"))
    return stage(held.where(F.col("n") - F.size("path") <= _spare(percent)).select("doc_id", "n", "path"), "paths")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Documents link when their sets of five-word shingles have a Jaccard similarity of ``percent``
    or more; a component is named after its smallest id.  Texts with fewer words are one shingle,
    texts without words (null and empty ones too) have none and link with nothing.  Rows without
    an id take no part (null component).  Rows that repeat an id are one document, which links as
    each of its texts does.  Other columns are not read; an empty table gives no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("the similarity is a percentage above 50")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = stage(map_texts(texts, ["doc_id"], "text", SKETCH, lambda: _sketch), "sketches")
    full = sketches.where("n > 0 AND doc_id IS NOT NULL")
    copied = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").select("digest", "rep")
    copied = stage(copied, "copies")
    placed = lookup_join(sketches.select("doc_id", "n", "digest"), copied, ["digest"], ["doc_id"], "left")
    placed = stage(placed.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "placed")
    known = lookup_join(full, copied, ["digest"], ["doc_id"], "left")
    first = known.where("doc_id = rep").dropDuplicates(["doc_id", "digest"])
    classes = stage(known.where("rep IS NULL").unionByName(first).select("doc_id", "digest", "n", "low"), "classes")
    sets = _paths(texts, classes, percent)
    # an id with several texts joins their classes
    several = placed.where("n > 0").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    ties = placed.where("rep <> doc_id").join(small_side(stage(several.select("doc_id"), "several")), "doc_id")
    ties = ties.select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))
    links = stage(_group_links(_first_branches(sets), percent).union(ties).distinct(), "links")
    labels = components(links)
    more = stage(_group_links(_open_branches(sets, labels, percent), percent).distinct(), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    named = labels.select(F.col("doc_id").alias("rep"), "component")
    joined = lookup_join(placed, named, ["rep"], ["doc_id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""
SQL = f"""
WITH RECURSIVE dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS s
  FROM dw),
cls AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM sh) WHERE len(s) > 0 GROUP BY s),
post AS MATERIALIZED (SELECT rep, n, unnest(s) AS h FROM cls),
pairs AS (
  SELECT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny, count(*) AS m FROM post a JOIN post b ON a.h = b.h AND a.rep < b.rep
  AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * m >= {PERCENT} * (nx + ny - m)),
edge AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT rep, rep FROM cls UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y),
comp AS (SELECT x AS rep, min(y) AS c FROM reach GROUP BY x)
SELECT sh.doc_id, len(sh.s) AS n_shingles, coalesce(c, sh.doc_id) AS component_id
FROM sh LEFT JOIN cls ON list_sort(sh.s) = cls.s LEFT JOIN comp USING (rep)"""
