"""Skew-safe joins, top-k per group and row multiplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
#: Facts of one key that a join leaves in one task.
HOT_ROWS = 250_000


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: variable parts as they are, 16 for every slot or header."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _width(x, kind.elementType))
            return F.coalesce(inner, F.lit(0)) + 16
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * 16 + 16
    return F.lit(16)


def fits_broadcast(dim: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure the lookup side: total bytes of its values against ``limit``."""
    width = sum((_width(F.col(f.name), f.dataType) for f in dim.schema.fields), F.lit(16))
    size = dim.agg(F.sum(width.cast("long")).alias("b")).first()["b"]
    return (size or 0) <= limit


def small_side(dim: DataFrame) -> DataFrame:
    """``dim``, marked for broadcast if it is measured small; otherwise the join shuffles, and
    adaptive execution splits hot keys."""
    return F.broadcast(dim) if fits_broadcast(dim) else dim


def key_counts(df: DataFrame, on: list[str]) -> DataFrame:
    """(on, _facts): rows per key, combined map-side."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_facts"))


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    salt_by: list[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    hot: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join a large, possibly skewed ``fact`` to a staged table with one row per ``on`` key.

    A measured small ``dim`` is broadcast.  Beside a larger one the facts are counted by key,
    map-side first; a key of more than ``hot`` facts is split into so many parts of about that
    size, and only its row of ``dim`` is copied, once per part.  All other rows join unsalted.

    Counting computes ``fact`` once more.  Where that is dear, ``counts`` (on, _facts) gives what is
    known of the facts per key; it says how keys are split and changes no result.
    """
    if fits_broadcast(dim, limit):
        return fact.join(F.broadcast(dim), on, how)
    taken = {c.lower() for c in (*fact.columns, *dim.columns)}
    if taken & {"_facts", "_parts", "_salt"}:
        # helper columns must not clash with those of the tables
        renamed = {c: f"__{i}" for i, c in enumerate(dict.fromkeys([*fact.columns, *dim.columns]))}
        back = {v: k for k, v in renamed.items()}
        joined = lookup_join(
            fact.withColumnsRenamed(renamed), dim.withColumnsRenamed(renamed), [renamed[c] for c in on], [renamed[c] for c in salt_by], how, limit, hot,
            None if counts is None else counts.withColumnsRenamed({c: renamed[c] for c in on}),
        )
        return joined.withColumnsRenamed(back)
    counts = (key_counts(fact, on) if counts is None else counts).where(F.col("_facts") > hot)
    parts = small_side(stage(counts.select(*on, F.ceil(F.col("_facts") / hot).cast("int").alias("_parts")), "hot"))
    # facts with a NULL key meet no row of dim; they are spread as well
    alone = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    split = fact.join(parts, on, "left").withColumn("_parts", F.coalesce("_parts", F.when(alone, SALTS).otherwise(1)))
    salted = split.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.col("_parts")).cast("int")).drop("_parts")
    copies = dim.join(parts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return salted.join(copies.drop("_parts"), [*on, "_salt"], how).drop("_salt")


def token_lookup(df: DataFrame, keys: list[str], tokens_col: str, dim: DataFrame, salt_by: list[str]) -> DataFrame:
    """(keys, term, n, dim columns): the tokens of every row found in ``dim(term, ...)``.

    Beside a broadcast ``dim`` the tokens stay where they are exploded (n = 1), and whatever sums
    them up per row combines map-side.  Otherwise they collapse to counts before they travel.
    """
    exploded = df.select(*keys, F.explode(tokens_col).alias("term"))
    if fits_broadcast(dim):
        return exploded.join(F.broadcast(dim), "term").withColumn("n", F.lit(1).cast("long"))
    counts = exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    # distinct tokens of each row are as many facts, and are counted without collapsing them first
    facts = key_counts(df.select(F.explode(F.array_distinct(tokens_col)).alias("term")), ["term"])
    return lookup_join(counts, dim, ["term"], salt_by, limit=-1, counts=facts)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group along a total ``order``.

    Up to 1000 Spark limits every map task to k rows per group before the shuffle; beyond that
    a salted first round does the same.
    """
    if k > 1000:
        keys = [c for c in df.columns if c not in group]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
        first = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
        df = salted.withColumn("_r", first).where(F.col("_r") <= k).drop("_r", "_salt")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def numbered_copies(df: DataFrame, n: str, index: str, chunk: int = 10_000) -> DataFrame:
    """Repeat each row ``n`` times, numbered from 0; long runs are split over tasks first."""
    last = F.floor((F.col(n) - 1) / F.lit(chunk)).cast("long")
    chunks = df.where(F.col(n) > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    upper = F.least(F.col("_c") * chunk + chunk, F.col(n)) - 1
    return (
        chunks.repartition("_c", *df.columns)
        .withColumn(index, F.explode(F.sequence(F.col("_c") * chunk, upper)))
        .drop("_c")
    )


def every_pair(left: DataFrame, right: DataFrame, block: int = 1000) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` (both distinct), for results that are such a grid.

    ``right`` is dealt into blocks of about ``block`` rows by hash, and each row of ``left`` meets
    every block by an ordinary join; neither side is collected.
    """
    blocks = -(-right.count() // block)
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(max(blocks, 1))).cast("int"))
    return left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)))).join(dealt, "_block").drop("_block")


def class_values(df: DataFrame, column: str, limit: int = 1000) -> list:
    """The distinct non-NULL values of a class column, sorted; refuses more than ``limit``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column {column} has more than {limit} distinct values")
    return sorted(r[0] for r in rows)
