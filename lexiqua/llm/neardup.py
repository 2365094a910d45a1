"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives a digest of the word sequence, the shingle count, a MinHash
   signature and its band keys.  Equal sequences collapse to one class, so copies never meet.
2. Every member of a band bucket is a candidate with one member that a hash picks per bucket.
   That is linear in the members and joins large groups of near copies to components.
3. What may still be missing are links between components.  Small buckets that span components
   give their pairs.  For members of larger ones a prefix filter takes over: two sets of
   similarity t share one of the rarest ``n - ceil(t n) + 1`` shingles of each, and where they
   first meet in the order of rarity, what is left of both must still suffice.  Here too each
   shingle first pairs its members with one hub, the set with the fewest rarer shingles, and
   only what still spans components afterwards is paired in full.
4. Candidates are pruned in batches of signature values: a pair goes as soon as the posterior
   probability of a similarity of at least t falls below the miss probability.  Survivors are
   verified on their full shingle sets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import lookup_join
from ..plans.staging import stage
from .common import map_texts, unused

SHINGLE = 5
#: Similarity as a percentage, so that the test on whole numbers is exact.
PERCENT = 75
#: 32 bands of 4 values miss a pair of similarity 0.75 with a probability of 5 in a million.
BANDS, ROWS = 32, 4
BATCH = 16
MISS = 1e-6
#: Buckets up to this size give their pairs directly, larger ones go through the prefix filter.
SMALL = 8
#: Shingles per numpy block.
BLOCK = 1 << 16

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
    """The joined lower-case words and the sorted distinct shingle hashes of every text."""
    number: defaultdict = defaultdict(count().__next__)
    rows, codes = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        rows.append(words)
        codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
    out = []
    with np.errstate(over="ignore"):
        for words, code in zip(rows, codes):
            h, n = hashes[code], min(len(code), SHINGLE)
            rolled = np.full(max(len(code) - SHINGLE + 1, min(len(code), 1)), n, np.uint64)
            for k in range(n):
                rolled = rolled * _MULTIPLY + h[k : k + len(rolled)]
            out.append((b" ".join(words), np.unique(_mixed(rolled))))
    return out


_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits each) of non-empty hash sets, one row per set."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= BLOCK):
                size += len(sets[end])
                end += 1
            joined = np.concatenate(sets[at:end])
            starts = np.r_[0, np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)] if end - at > 1 else np.zeros(1, np.int64)
            for k in range(BANDS * ROWS):
                values = ((joined * _FACTORS[k] + _OFFSETS[k]) >> np.uint64(32)).astype(np.uint32)
                out[at:end, k] = np.minimum.reduceat(values, starts)
            at = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands' keys being unrelated."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
        for r in range(ROWS):
            keys = _mixed(keys * _MULTIPLY + parts[:, :, r] + np.uint64(1))
    return keys.view(np.int64)


SKETCH = T.StructType(
    [
        T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def _sketch(texts: list[str]) -> dict:
    sets = shingle_sets(texts)
    full = [i for i, (_, s) in enumerate(sets) if len(s)]
    sig = signatures([sets[i][1] for i in full])
    keys = band_keys(sig)
    out: dict[str, list] = {"digest": [None] * len(sets), "n": [len(s) for _, s in sets], "sig": [None] * len(sets), "keys": [None] * len(sets)}
    for row, i in enumerate(full):
        out["digest"][i] = blake2b(sets[i][0], digest_size=16).digest()
        out["sig"][i] = sig[row].tobytes()
        out["keys"][i] = keys[row]
    return out


def _sets(texts: list[str]) -> dict:
    return {"s": [s.view(np.int64) for _, s in shingle_sets(texts)]}


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For 0 .. BANDS*ROWS compared values the fewest matches that keep a pair: below, the posterior
    probability of similarity >= t, from a uniform prior, is under ``miss``.

    With m of n matching it is P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BANDS * ROWS + 1):
        total, m = 0.0, -1
        while m < n and total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _survivors(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (x, y, sx, sy) that no batch of signature values prunes."""
    least = least_matches(percent, miss)
    width = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, width) for c in (2, 3))
            open_ = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for a in range(0, width, BATCH):
                matches[open_] += (x[open_, a : a + BATCH] == y[open_, a : a + BATCH]).sum(axis=1)
                open_ = open_[matches[open_] >= least[min(a + BATCH, width)]]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(open_)) for c in (0, 1)], names=["x", "y"])

    return pairs.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, miss: float) -> DataFrame:
    """(x, y): those candidate pairs that are linked."""
    def side(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
        return df.select(F.col("doc_id").alias(key), F.col(column).alias(name))

    pairs = stage(pairs.distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    wanted = stage(pairs.select(F.col("x").alias("doc_id")).union(pairs.select(F.col("y").alias("doc_id"))).distinct(), "wanted")
    sigs = stage(lookup_join(classes.select("doc_id", "sig"), wanted, ["doc_id"], ["doc_id"]), "sigs")
    with_sigs = pairs.join(side(sigs, "x", "sig", "sx"), "x").join(side(sigs, "y", "sig", "sy"), "y")
    close = stage(_survivors(with_sigs, percent, miss), "close")
    ids = stage(close.select(F.col("x").alias("doc_id")).union(close.select(F.col("y").alias("doc_id"))).distinct(), "close-ids")
    sets = stage(_shingles(texts, ids), "sets")
    full = close.join(side(sets, "x", "s", "sx"), "x").join(side(sets, "y", "s", "sy"), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    linked = full.where(100 * shared >= percent * (F.size("sx") + F.size("sy") - shared))
    return stage(linked.select("x", "y"), "links")


def _shingles(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, s): the shingle sets of the documents in ``ids``."""
    found = lookup_join(texts, ids, ["doc_id"], ["doc_id"])
    return map_texts(found, ["doc_id"], "text", T.StructType([T.StructField("s", T.ArrayType(T.LongType()))]), lambda: _sets)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) for every linked document: the smallest id that it reaches.

    Each round every node points to its smallest neighbour, pointers are followed to their roots,
    and the roots' graph is what the next round works on.
    """
    edges = stage(links.select(F.col("x").alias("u"), F.col("y").alias("v")), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = stage(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "pointers")
        while True:
            step = lookup_join(to, to.select(F.col("u").alias("p"), F.col("p").alias("q")), ["p"], ["u"])
            moved = stage(step.select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("m")), "pointers")
            to = moved.select("u", "p")
            if moved.where("m").isEmpty():
                break
        left = lookup_join(edges, to, ["u"], ["v"]).select(F.col("p").alias("a"), "v")
        right = lookup_join(left, to.withColumnRenamed("u", "v"), ["v"], ["a"]).select("a", F.col("p").alias("b")).where("a <> b")
        edges = stage(right.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        if labels is None:
            labels = to.select(F.col("u").alias("doc_id"), F.col("p").alias("component"))
        else:
            named = to.select(F.col("u").alias("component"), F.col("p").alias("root"))
            labels = lookup_join(labels, named, ["component"], ["doc_id"], "left").select("doc_id", F.coalesce("root", "component").alias("component"))
        labels = stage(labels, "labels")
    if labels is None:
        return links.select(F.col("x").alias("doc_id"), F.col("y").alias("component")).limit(0)
    return labels


def _known(members: DataFrame, labels: DataFrame) -> DataFrame:
    joined = lookup_join(members, labels, ["doc_id"], ["key"], "left")
    return joined.withColumn("component", F.coalesce("component", "doc_id"))


def _open(members: DataFrame) -> DataFrame:
    """The members of keys that span more than one component, with the key's size ``m``."""
    spans = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    wide = stage(spans.where("lo <> hi").select("key", "m"), "wide")
    return lookup_join(members, wide, ["key"], ["doc_id"])


def _fits(percent: int, nx: str, ny: str, rx: str | None = None, ry: str | None = None) -> Column:
    """Whether sets of these sizes can be similar enough; with ``rx`` and ``ry``, the places of
    their first common shingle in the order of rarity, whether what is left of them suffices."""
    nx, ny = F.col(nx), F.col(ny)
    most = F.least(nx, ny) if rx is None else 1 + F.least(nx - F.col(rx), ny - F.col(ry))
    return (100 + percent) * most >= percent * (nx + ny)


def _cross(members: DataFrame, percent: int, place: str | None = None) -> DataFrame:
    """Pairs of one key from different components that can be similar enough."""
    names = {"doc_id": "", "component": "c", "n": "n", **({place: "r"} if place else {})}
    a, b = (members.select("key", *[F.col(c).alias(p + side) for c, p in names.items()]) for side in "xy")
    fits = _fits(percent, "nx", "ny", *(("rx", "ry") if place else ()))
    return a.join(b, "key").where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & fits).select("x", "y")


def _prefixes(hot: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, n, r): the rarest shingles of the documents ``hot`` that others hold too, and
    their places ``r`` (from 1) in the order of rarity."""
    each = stage(_shingles(texts, hot).select("doc_id", F.size("s").cast("long").alias("n"), F.explode("s").alias("key")), "hot")
    often = stage(each.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    rated = lookup_join(each, often, ["key"], ["doc_id"], "left").withColumn("f", F.coalesce("f", F.lit(1)))
    rarest = F.row_number().over(Window.partitionBy("doc_id").orderBy("f", "key"))
    prefix = rated.withColumn("r", rarest).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return stage(prefix.where("f > 1").select("key", "doc_id", "n", "r"), "prefixes")


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Every member of a key that spans components with the key's hub."""
    hubs = stage(members.groupBy("key").agg(F.min(F.struct("r", "n", "doc_id", "component")).alias("hub")), "hubs")
    hubs = hubs.select("key", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("r", "n", "doc_id", "component")])
    both = lookup_join(members, hubs, ["key"], ["doc_id"]).where(F.col("component") != F.col("hub_component"))
    return both.where(_fits(percent, "n", "hub_n", "r", "hub_r")).select(F.least("doc_id", "hub_doc_id").alias("x"), F.greatest("doc_id", "hub_doc_id").alias("y"))


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, miss: float = MISS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Texts without words (null and empty ones too) have no shingles and link with nothing; rows
    without ``doc_id`` take no part and are kept; rows that repeat an id are one document.  Other
    columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = stage(map_texts(texts, ["doc_id"], "text", SKETCH, lambda: _sketch), "sketches")
    full = sketches.where("n > 0 AND doc_id IS NOT NULL")
    # equal word sequences: one class, named after its smallest id
    copied = stage(
        full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").select("digest", "rep"), "copies"
    )
    placed = lookup_join(sketches.select("doc_id", "n", "digest"), copied, ["digest"], ["doc_id"], "left")
    placed = stage(placed.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "placed")
    # a class is represented by its smallest id; the other copies go
    others = stage(placed.where("n > 0 AND doc_id <> rep").select("doc_id").distinct().withColumn("copy", F.lit(True)), "others")
    classes = lookup_join(full, others, ["doc_id"], ["doc_id"], "left").where("copy IS NULL")
    classes = stage(classes.select("doc_id", "n", "sig", "keys"), "classes")

    rows = classes.select("doc_id", "n", F.explode("keys").alias("key"))
    picked = F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), F.col("doc_id").alias("star")))
    buckets = stage(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), picked.alias("p")).where("m > 1").select("key", F.col("p.star").alias("star")), "buckets"
    )
    members = stage(lookup_join(rows, buckets, ["key"], ["doc_id"]), "members")
    stars = members.where("doc_id <> star").select(F.least("doc_id", "star").alias("x"), F.greatest("doc_id", "star").alias("y"))
    links = _verified(stars, classes, texts, percent, miss)
    labels = components(links)

    unsettled = stage(_open(_known(members.drop("star"), labels)), "unsettled")
    hot = stage(unsettled.where(F.col("m") > SMALL).select("doc_id").distinct(), "hot-ids")
    pairs = _cross(unsettled.where(F.col("m") <= SMALL), percent)
    prefixes = None if hot.isEmpty() else _prefixes(hot, texts, percent)
    if prefixes:
        pairs = pairs.unionByName(_hub_pairs(_open(stage(_known(prefixes, labels), "places")), percent))
    more = _verified(pairs, classes, texts, percent, miss)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    if prefixes:
        rest = _verified(_cross(_open(stage(_known(prefixes, labels), "places")), percent, "r"), classes, texts, percent, miss)
        if not rest.isEmpty():
            labels = components(links.unionByName(rest))
    named = labels.select(F.col("doc_id").alias("rep"), "component")
    joined = lookup_join(placed, named, ["rep"], ["doc_id"], "left")
    component = F.coalesce("component", "rep")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that a smaller id of their component stands for."""
    key = unused(docs, "_copy")
    found = near_duplicates(docs, percent, doc_id=doc_id, text=text)
    gone = stage(found.where("NOT kept").select(F.col("doc_id").alias(key)).distinct().withColumn(f"{key}hit", F.lit(True)), "gone")
    flagged = lookup_join(docs.withColumn(key, F.col(doc_id)), gone, [key], [key], "left")
    return flagged.where(F.col(f"{key}hit").isNull()).select(*docs.columns)


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
SELECT sh.doc_id, len(sh.s) AS n_shingles, coalesce(c, sh.doc_id) AS component_id, coalesce(c, sh.doc_id) = sh.doc_id AS kept
FROM sh LEFT JOIN cls ON list_sort(sh.s) = cls.s LEFT JOIN comp USING (rep)"""
