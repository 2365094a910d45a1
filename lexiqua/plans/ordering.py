"""Order statistics without a single-task sort.

A window with no partition, or one partitioned by a class that holds a third of the rows,
would run in one task.  Here rows are range-partitioned by (group, order), each range is a
block, and block totals (one row per block and group) carry the running sums across blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import lookup_join, small_side
from .staging import stage


def _null_safe(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    totals: dict[str, str],
    grand: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums ``totals[out] = column`` along ``order`` inside ``group``.

    ``order`` must be total inside a group.  ``grand`` adds the whole group's sums.
    """
    grand = grand or {}
    ranged = df.repartitionByRange(*[F.col(g).asc() for g in group], *order)
    staged = stage(ranged.withColumn("_blk", F.spark_partition_id()), "ordered")
    keys = [*group, "_blk"]
    sources = sorted({*totals.values(), *grand.values()})
    per_block = staged.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sources])
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = across.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_base_{o}") for o, c in totals.items()],
        *[F.sum(f"_sum_{c}").over(across).alias(o) for o, c in grand.items()],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.select("*", *[F.sum(c).over(inside).alias(f"_in_{o}") for o, c in totals.items()])
    joined = local.alias("l").join(base.alias("b"), _null_safe("l", "b", keys))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"_in_{o}") + F.col(f"_base_{o}")).alias(o) for o in totals],
        *[F.col(f"b.{o}") for o in grand],
    )


def row_positions(df: DataFrame, group: list[str], order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """0-based position of every row along ``order`` inside ``group`` (and the group's size)."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    grand = {total: "_one"} if total else {}
    return (
        running_totals(counted, group, order, {name: "_one"}, grand)
        .withColumn(name, F.col(name) - 1)
        .drop("_one")
    )


SKETCH_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group; NULL and NaN are ignored.

    A quantile sketch brackets each wanted value between two close ones.  Rows below a bracket are
    only counted, just the rows inside it (some 1/2500 of a large group) are shuffled and ranked.
    A wanted rank can also be the very next value outside its bracket, which the counting pass
    brings along; the sketch's error bound excludes anything farther, and the query would fail.
    """
    # a struct compares NULL fields as equal, so rows without a group are a group of their own
    keys = ["_g"]
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number))
    rows = rows.select((F.struct(*group) if group else F.lit(0)).alias("_g"), number.alias("_x"))
    slack = 2.0 / SKETCH_ACCURACY
    edges = [e for p in probs.values() for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    heads = stage(
        rows.groupBy(*keys).agg(F.percentile_approx("_x", edges, SKETCH_ACCURACY).alias("_e"), F.count(F.lit(1)).alias("_all")), "sketch"
    )
    places = range(len(probs))
    low, high = [F.col("_e")[2 * i] for i in places], [F.col("_e")[2 * i + 1] for i in places]
    placed = lookup_join(rows, heads.drop("_all"), keys, salt_by=["_x"])
    x = F.col("_x")
    outside = stage(
        placed.groupBy(*keys).agg(
            *[F.count(F.when(x < low[i], 1)).alias(f"_b_{i}") for i in places],
            *[F.max(F.when(x < low[i], x)).alias(f"_prev_{i}") for i in places],
            *[F.min(F.when(x > high[i], x)).alias(f"_next_{i}") for i in places],
        ).join(heads.drop("_e"), keys),
        "outside",
    )
    hits = F.array_compact(F.array(*[F.when((x >= low[i]) & (x <= high[i]), F.lit(i)) for i in places]))
    counts = placed.select(*keys, "_x", F.explode(hits).alias("_p")).groupBy(*keys, "_p", "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranked = lookup_join(running_totals(counts, [*keys, "_p"], [x.asc()], {"_upto": "_n"}), outside, keys, salt_by=["_x"])

    def wanted(i: int, p: float, of: Callable[[Column], Column]) -> Column:
        return of(F.lit(float(p)) * (F.col("_all") - 1)) - F.col(f"_b_{i}")

    sides = {"lo": F.floor, "hi": F.ceil}
    aggs = [F.max(F.when(F.col("_p") == i, F.col("_upto"))).alias(f"_m_{i}") for i in places]
    for i, p in enumerate(probs.values()):
        for side, of in sides.items():
            rank = wanted(i, p, of)
            here = (F.col("_p") == i) & (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            aggs.append(F.max(F.when(here, x)).alias(f"_{side}_{i}"))
    found = ranked.groupBy(*keys).agg(*aggs).join(outside, keys)
    values = []
    for i, (out, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("_all") - 1)
        ends = [
            F.when(wanted(i, p, of) == -1, F.col(f"_prev_{i}")).when(wanted(i, p, of) == F.col(f"_m_{i}"), F.col(f"_next_{i}")).otherwise(F.col(f"_{side}_{i}"))
            for side, of in sides.items()
        ]
        lower, upper = [F.coalesce(e, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")) for e in ends]
        values.append((lower + (upper - lower) * (at - F.floor(at))).alias(out))
    if group:
        return found.select(*[F.col("_g")[g].alias(g) for g in group], *values)
    # without rows there is no group; an ungrouped call still gives its one row, of NULLs
    return found.select(*values).agg(*[F.max(o).alias(o) for o in probs])


def hash_cuts(df: DataFrame, group: list[str], key: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group, the key up to which exactly ``wanted[name](group size)`` rows lie.

    ``key`` is a unique hex digest.  Only counts per (group, key prefix) are ranked; rows are
    ranked one by one just inside the prefix where a cut falls, so a hot group never reaches one
    task.  A group that wants no row gets a NULL cut.
    """
    prefixed = df.select(*group, key, F.substring(key, 1, 4).alias("_pre"))
    counts = prefixed.groupBy(*group, "_pre").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select(
        *group,
        "_pre",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    size = F.col("_size")
    cuts = [
        F.struct(F.lit(name).alias("name"), F.least(rule(size).cast("long"), size).alias("want"))
        for name, rule in wanted.items()
    ]
    inside = (F.col("_before") < F.col("_c.want")) & (F.col("_c.want") <= F.col("_before") + F.col("_n"))
    targets = (
        ranges.withColumn("_c", F.explode(F.array(*cuts)))
        .where(inside)
        .select(*group, "_pre", F.col("_c.name").alias("_name"), (F.col("_c.want") - F.col("_before")).alias("_need"))
    )
    # one row per group and cut: as many as there are classes
    keys = [*group, "_pre"]
    targets = small_side(stage(targets, "targets"))
    border = prefixed.alias("p").join(targets.alias("t"), _null_safe("p", "t", keys)).select(
        *[F.col(f"p.{c}") for c in keys], F.col(f"p.{key}").alias(key), "_name", "_need"
    )
    nth = F.row_number().over(Window.partitionBy(*keys, "_name").orderBy(key))
    found = border.withColumn("_r", nth).where(F.col("_r") == F.col("_need"))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == n, F.col(key))).alias(n) for n in wanted])


def flag_by_hash(
    df: DataFrame, group: list[str], key: str, wanted: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Boolean column per cut: the row is among the group's first ``wanted`` rows by ``key``."""
    cuts = stage(hash_cuts(df, group, key, wanted), "cuts")
    renamed = small_side(cuts.select(*group, *[F.col(n).alias(f"_cut_{n}") for n in wanted]))
    joined = df.alias("d").join(renamed.alias("c"), _null_safe("d", "c", group), "left")
    flags = [F.coalesce(F.col(key) <= F.col(f"_cut_{n}"), F.lit(False)).alias(n) for n in wanted]
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], *flags)
