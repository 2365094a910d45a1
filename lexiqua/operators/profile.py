"""Class-wise counts, histograms, quantiles, correlation and outliers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import class_values, every_pair, lookup_join, top_k
from ..plans.ordering import exact_quantiles
from ..plans.staging import stage

ALL = "all"


def with_all(df: DataFrame, class_col: str) -> DataFrame:
    """Every row once under its class and once under 'all' (a narrow step; counts combine map-side)."""
    return df.withColumn(class_col, F.explode(F.array(F.col(class_col).cast("string"), F.lit(ALL))))


def values_by_class(df: DataFrame, value_col: str, class_col: str) -> DataFrame:
    return df.groupBy(class_col, value_col).agg(F.count(F.lit(1)).alias("n"))


def top_values(
    counts: DataFrame, group: list[str], value_col: str, k: int, n_col: str = "n"
) -> DataFrame:
    """The k most frequent values of each group; ties by value."""
    return top_k(counts, group, [F.col(n_col).desc(), F.col(value_col).asc()], k)


def top_tokens_by_class(df: DataFrame, tokens_col: str, class_col: str, k: int = 20) -> DataFrame:
    counts = values_by_class(df.select(class_col, F.explode(tokens_col).alias("token")), "token", class_col)
    return top_values(counts, [class_col], "token", k)


def token_weights_by_class(df: DataFrame, tokens_col: str, class_col: str, k: int = 200) -> DataFrame:
    """Word-cloud weights: counts relative to the class's most frequent token."""
    top = top_tokens_by_class(df, tokens_col, class_col, k)
    # at most k rows per class are left here
    peak = F.max("n").over(Window.partitionBy(class_col))
    return top.select(class_col, "token", "n", (F.col("n") / peak).alias("weight"))


def tag_frequencies(df: DataFrame, tags_col: str, class_col: str) -> DataFrame:
    """Tag counts per class and over all rows."""
    tags = df.select(F.col(class_col).alias("class"), F.explode(tags_col).alias("tag"))
    per_class = tags.groupBy("class", "tag").agg(F.count(F.lit(1)).alias("n"))
    return with_all(per_class, "class").groupBy("class", "tag").agg(F.sum("n").alias("n"))


def top_entities(df: DataFrame, entities_col: str, class_col: str, k: int = 10) -> DataFrame:
    """Most frequent entity texts per class and over all rows; a class without any has no row."""
    found = df.select(F.col(class_col).alias("class"), F.explode(F.col(f"{entities_col}.text")).alias("entity"))
    per_class = found.groupBy("class", "entity").agg(F.count(F.lit(1)).alias("n"))
    counts = with_all(per_class, "class").groupBy("class", "entity").agg(F.sum("n").alias("n"))
    return top_values(counts, ["class"], "entity", k)


def category_distribution(df: DataFrame, class_col: str, category_col: str) -> DataFrame:
    """Counts of every category in every class and in 'all', zeros included.

    The rows are counted once; a category's zeros come from the classes among those counts, however
    many these are.
    """
    counts = stage(
        df.groupBy(F.col(category_col).alias("category"), F.col(class_col).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n")), "cells"
    )
    categories = counts.select("category").distinct()
    classes = stage(counts.where(F.col("class").isNotNull()).select("class").distinct(), "classes")
    same = F.col("g.category").eqNullSafe(F.col("c.category")) & (F.col("g.class") == F.col("c.class"))
    cells = every_pair(categories, classes).alias("g").join(counts.alias("c"), same, "left")
    cells = cells.select("g.category", "g.class", F.coalesce("c.n", F.lit(0).cast("long")).alias("n"))
    return cells.unionByName(counts.groupBy("category").agg(F.lit(ALL).alias("class"), F.sum("n").alias("n")))


def bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of x in [low, high], the right edge in the last bin; one value spans ±0.5."""
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    return F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def score_histogram(df: DataFrame, class_col: str, value_col: str, bins: int = 20) -> DataFrame:
    """Histogram per class plus 'all', each over its own value range; empty bins have no row."""
    rows = with_all(df.select(F.col(class_col).alias("class"), F.col(value_col).cast("double").alias("x")), "class")
    return histogram(rows.where(F.col("x").isNotNull() & ~F.isnan("x")), ["class"], "x", bins)


def histogram(df: DataFrame, group: list[str], value_col: str, bins: int) -> DataFrame:
    """(group, bin, n, lo, hi) with per-group ranges."""
    edges = stage(df.groupBy(*group).agg(F.min(value_col).alias("lo"), F.max(value_col).alias("hi")), "ranges")
    binned = lookup_join(df, edges, group, salt_by=[value_col]).withColumn(
        "bin", bin_index(F.col(value_col), F.col("lo"), F.col("hi"), bins)
    )
    return binned.groupBy(*group, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


QUARTILES = {"p00": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def distribution_by_category(df: DataFrame, value_col: str, category_col: str, bins: int = 10) -> DataFrame:
    """Histogram counts and quartiles per category in one tidy table (category, kind, key, value)."""
    rows = df.select(F.col(category_col).alias("category"), F.col(value_col).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    bars = histogram(rows, ["category"], "x", bins).select(
        "category", F.lit("bin").alias("kind"), F.col("bin").cast("string").alias("key"), F.col("n").cast("double").alias("value")
    )
    quartiles = exact_quantiles(rows, ["category"], "x", QUARTILES).select(
        "category",
        F.lit("quantile").alias("kind"),
        F.inline(F.array(*[F.struct(F.lit(q).alias("key"), F.col(q).alias("value")) for q in QUARTILES])),
    )
    return bars.unionByName(quartiles)


def density_by_category(df: DataFrame, value_col: str, category_col: str, points: int = 100, cut: float = 2.0) -> DataFrame:
    """Gaussian kernel density per category on ``points`` places: (category, point, x, density).

    The bandwidth follows from deviation and exact quartiles, 0.9 min(s, IQR / 1.34) n^-1/5 (Silverman
    1986); a quartile range of 0 leaves the deviation.  Places reach ``cut`` bandwidths beyond the
    extremes.  Every value is shared by its two neighbouring places in proportion, so rows are
    read twice and the kernel meets at most ``points`` weights a category.  Categories whose values are all
    equal have no density; null and NaN values are skipped.
    """
    rows = df.select(F.col(category_col).alias("category"), F.col(value_col).cast("double").alias("x"))
    rows = stage(rows.where(F.col("x").isNotNull() & ~F.isnan("x")), "values")
    spread_ = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    quartiles = exact_quantiles(rows, ["category"], "x", {"q1": 0.25, "q3": 0.75})
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    h = 0.9 * F.when(iqr > 0, F.least("s", iqr)).otherwise(F.col("s")) * F.pow("n", -0.2)
    grid = spread_.join(quartiles, "category").select("category", "n", "lo", "hi", h.alias("h")).where("h > 0")
    grid = grid.withColumn("from", F.col("lo") - cut * F.col("h")).withColumn("step", (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1))
    grid = stage(grid.select("category", "n", "h", "from", "step"), "grid")
    place = (F.col("x") - F.col("from")) / F.col("step")
    below = F.least(F.floor("place"), F.lit(points - 2))
    shares = F.array(
        F.struct(below.alias("bin"), (1 - (F.col("place") - below)).alias("w")), F.struct((below + 1).alias("bin"), (F.col("place") - below).alias("w"))
    )
    placed = lookup_join(rows, grid, ["category"], salt_by=["x"]).withColumn("place", place)
    weights = placed.select("category", F.inline(shares)).groupBy("category", "bin").agg(F.sum("w").alias("w"))
    targets = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    apart = (F.col("point") - F.col("bin")) * F.col("step") / F.col("h")
    each = targets.join(stage(weights, "weights"), "category").withColumn("k", F.col("w") * F.exp(-0.5 * apart * apart))
    summed = each.groupBy("category", "point", "from", "step", "n", "h").agg(F.sum("k").alias("k"))
    density = F.col("k") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return summed.select("category", "point", (F.col("from") + F.col("point") * F.col("step")).alias("x"), density.alias("density"))


def crosstab(df: DataFrame, row_col: str, class_col: str, classes: list | None = None) -> DataFrame:
    """Rows = values of ``row_col``, one count column per class."""
    classes = classes or class_values(df, class_col)
    return df.groupBy(row_col).agg(*[F.count(F.when(F.col(class_col) == c, 1)).alias(str(c)) for c in classes])


def column_profile(df: DataFrame, target_col: str, exclude: list[str] = (), bins: int = 10, few: int = 10) -> DataFrame:
    """One tidy profile of every column: (column, kind, bucket, class, n).

    The target gives value counts; whole-number columns of at most ``few`` distinct values and
    string columns give cross counts; other numbers give a histogram per class over the class's
    own value range.
    """
    fields = [f for f in df.schema.fields if f.name not in exclude]
    whole = [f.name for f in fields if isinstance(f.dataType, (T.LongType, T.IntegerType)) and f.name != target_col]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType) and f.name != target_col]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType) and f.name != target_col]
    # a tiny set per column decides; more than ``few`` values need not be told apart exactly
    distinct = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in whole]).first() if whole else {}
    maybe = [c for c in whole if distinct[c] <= 2 * few]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in maybe]).first() if maybe else {}
    counted = [c for c in maybe if exact[c] <= few]
    measured = [c for c in numeric if c not in counted]
    label = F.col(target_col).cast("string").alias("class")
    cells = [F.struct(F.lit(target_col).alias("column"), F.lit("target").alias("kind"), F.col(target_col).cast("string").alias("bucket"))]
    cells += [
        F.struct(F.lit(c).alias("column"), F.lit("cross").alias("kind"), F.col(c).cast("string").alias("bucket"))
        for c in [*counted, *strings]
    ]
    crossed = df.select(label, F.inline(F.array(*cells))).groupBy("column", "kind", "bucket", "class").agg(
        F.count(F.lit(1)).alias("n")
    )
    if not measured:
        return crossed
    melted = df.select(
        label,
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in measured])),
    ).where(F.col("x").isNotNull() & ~F.isnan("x"))
    bars = histogram(melted, ["column", "class"], "x", bins).select(
        "column", F.lit("histogram").alias("kind"), F.col("bin").cast("string").alias("bucket"), "class", "n"
    )
    return crossed.unionByName(bars)


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation below the diagonal: one pass, one row per pair."""
    pairs = list(combinations(columns, 2))
    cells = [
        F.struct(F.lit(b).alias("row_feature"), F.lit(a).alias("col_feature"), F.corr(a, b).alias("corr"))
        for a, b in pairs
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def melt(df: DataFrame, columns: list[str], name: str = "feature", value: str = "x") -> DataFrame:
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def boxplot_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and outlier count of each column."""
    rows = melt(df, columns)
    quartiles = exact_quantiles(rows, ["feature"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    marked = rows.where(F.col("x").isNotNull() & ~F.isnan("x")).join(F.broadcast(quartiles), "feature").withColumn(
        "_in", (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    )
    return marked.groupBy("feature", "q1", "median", "q3").agg(
        F.min(F.when(F.col("_in"), F.col("x"))).alias("whisker_low"),
        F.max(F.when(F.col("_in"), F.col("x"))).alias("whisker_high"),
        F.count(F.when(~F.col("_in"), 1)).alias("outliers"),
    )


def pairwise_bins(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Binned joint counts of every pair of columns: the table behind a scatter matrix."""
    ranges = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
    ).first()
    index = {
        c: bin_index(F.col(c).cast("double"), F.lit(ranges[f"lo_{c}"]), F.lit(ranges[f"hi_{c}"]), bins) for c in columns
    }
    pairs = [
        F.struct(F.lit(a).alias("x_feature"), F.lit(b).alias("y_feature"), F.col(f"_b_{a}").alias("x_bin"), F.col(f"_b_{b}").alias("y_bin"))
        for a, b in combinations(columns, 2)
    ]
    binned = df.select(*[index[c].alias(f"_b_{c}") for c in columns])
    return (
        binned.select(F.inline(F.array(*pairs)))
        .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy("x_feature", "y_feature", "x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def status_label_shares(
    df: DataFrame, status_col: str, target_col: str, prediction_col: str, statuses: list[str], labels: list[str]
) -> DataFrame:
    """Percentage of each label within each status, for truth and prediction; absent status NULL."""
    cells = []
    for status in statuses:
        in_status = F.col(status_col) == status
        size = F.count(F.when(in_status, 1))
        for source, column in (("target", target_col), ("prediction", prediction_col)):
            for label in labels:
                n = F.count(F.when(in_status & (F.col(column) == label), 1))
                share = F.when(size > 0, F.round(n / size * 100, 1))
                cells.append(
                    F.struct(
                        F.lit(status).alias("status"),
                        F.lit(source).alias("source"),
                        F.lit(label).alias("label"),
                        share.alias("percent"),
                    )
                )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def class_deficits(df: DataFrame, class_col: str) -> DataFrame:
    """Rows per class and how many each lacks to reach the largest class."""
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    # one row per class reaches this window
    peak = F.max("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("deficit", peak - F.col("n"))


def remove_outliers(
    df: DataFrame, columns: list[str], keep_col: str | None = None, mode: str = "sequential"
) -> tuple[DataFrame, DataFrame]:
    """Drop rows outside 1.5 IQR, column after column; returns (kept rows, removal counts).

    ``sequential`` takes each column's quartiles from the rows the former columns left;
    ``independent`` takes all quartiles from the full table in one job.  A NULL fails its column's
    test.  Rows whose ``keep_col`` is true always stay.
    """
    names = {"q1": 0.25, "q3": 0.75}
    kept = df
    tests: list[tuple[str, Column]] = []

    def test(column: str, q1: float | None, q3: float | None) -> Column:
        reach = (q3 - q1) * 1.5 if q1 is not None else 0.0
        low, high = (q1 - reach, q3 + reach) if q1 is not None else (None, None)
        # NaN is above every number for Spark, so the upper bound fails it like NULL
        ok = F.coalesce((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)), F.lit(False))
        return ok | F.coalesce(F.col(keep_col), F.lit(False)) if keep_col else ok

    if mode == "independent":
        found = {r["feature"]: r for r in exact_quantiles(melt(df, columns), ["feature"], "x", names).collect()}
        for c in columns:
            row = found.get(c)
            tests.append((c, test(c, row["q1"] if row else None, row["q3"] if row else None)))
    elif mode == "sequential":
        # the source is read once; every column's round reads the numbers only
        named = [*columns, keep_col] if keep_col else columns
        kept = stage(df.select(*named), "numbers")
        for c in columns:
            row = exact_quantiles(kept.select(F.col(c).cast("double").alias("x")), [], "x", names).first()
            tests.append((c, test(c, row["q1"], row["q3"])))
            kept = kept.where(tests[-1][1])
    else:
        raise ValueError("mode must be 'sequential' or 'independent'")
    # which test removes a row first is a per-row fact, so all counts come from one pass
    failing = F.lit(None).cast("int")
    for i, (_, ok) in reversed(list(enumerate(tests))):
        failing = F.when(~ok, F.lit(i)).otherwise(failing)
    cells = [
        F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("column"), F.count(F.when(F.col("_first") == i, 1)).alias("removed"))
        for i, (c, _) in enumerate(tests)
    ]
    removed = df.select(failing.alias("_first")).agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    for _, ok in tests:
        df = df.where(ok)
    return df, removed
