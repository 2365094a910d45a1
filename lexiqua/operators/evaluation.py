"""Confusion matrices, metrics and threshold sweeps.

Row-level predictions are touched once: they collapse to (truth, prediction) counts or to one row
per (class, distinct score).  Everything after that works on those small or ordered tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import every_pair
from ..plans.ordering import running_totals
from ..plans.staging import stage


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0/0 -> 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- confusion matrix and metrics

def cell_counts(df: DataFrame, truth: str, prediction: str, group: list[str] = ()) -> DataFrame:
    return df.groupBy(*group, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(truth, prediction, n) with every label pair present, zeros included.

    The rows are counted once; labels and zeros come from those counts.  A NULL truth has a row of
    pairs too where it occurs, a NULL prediction none.
    """
    counts = stage(cell_counts(df, truth, prediction), "cells")
    labels = counts.select(F.explode(F.array("truth", "prediction")).alias("prediction")).where(F.col("prediction").isNotNull()).distinct()
    labels = stage(labels, "labels")
    truths = labels.select(F.col("prediction").alias("truth")).union(counts.where(F.col("truth").isNull()).select("truth")).distinct()
    grid = every_pair(truths, labels)
    same = F.col("g.truth").eqNullSafe(F.col("c.truth")) & (F.col("g.prediction") == F.col("c.prediction"))
    joined = grid.alias("g").join(counts.alias("c"), same, "left")
    return joined.select("g.truth", "g.prediction", F.coalesce("c.n", F.lit(0).cast("long")).alias("n"))


def class_counts(df: DataFrame, truth: str, prediction: str, group: list[str] = ()) -> DataFrame:
    """(group, class, tp, fp, fn, support) over labels seen as truth or prediction."""
    cells = cell_counts(df, truth, prediction, group)
    hit = F.col("truth") == F.col("prediction")
    sides = F.when(
        hit, F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))
    ).otherwise(
        F.array(
            F.struct(F.col("truth").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")),
        )
    )
    return (
        cells.select(*group, F.inline(sides))
        .groupBy(*group, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .withColumn("support", F.col("tp") + F.col("fn"))
    )


METRICS = (
    "accuracy", "f1_macro", "f1_micro", "f1_weighted", "precision_macro", "precision_micro",
    "precision_weighted", "recall_macro", "recall_micro", "recall_weighted",
)


def classification_metrics(df: DataFrame, truth: str, prediction: str, group: list[str] = ()) -> DataFrame:
    """(group, metric, value): accuracy and macro/micro/weighted F1, precision and recall."""
    group = list(group)
    per_class = class_counts(df, truth, prediction, group).select(
        *group,
        "tp",
        "fp",
        "fn",
        "support",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )
    total = F.sum("support")
    values = {"accuracy": _ratio(F.sum("tp"), total)}
    values["f1_micro"] = _ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    values["precision_micro"] = _ratio(F.sum("tp"), F.sum("tp") + F.sum("fp"))
    values["recall_micro"] = _ratio(F.sum("tp"), total)
    for m in ("f1", "precision", "recall"):
        values[f"{m}_macro"] = F.coalesce(F.avg(m), F.lit(0.0))
        values[f"{m}_weighted"] = _ratio(F.sum(F.col(m) * F.col("support")), total)
    cells = [F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in METRICS]
    return per_class.groupBy(*group).agg(F.array(*cells).alias("cells")).select(*group, F.inline("cells"))


def binary_metrics(df: DataFrame, truth: str, prediction: str, positive, group: list[str] = ()) -> DataFrame:
    """Accuracy, F1, precision and recall of the positive class: one row per group."""
    group = list(group)
    t, p = F.col(truth) == positive, F.col(prediction) == positive
    tp, fp, fn = (F.count(F.when(c, 1)) for c in (t & p, ~t & p, t & ~p))
    right = F.count(F.when(F.col(truth) == F.col(prediction), 1))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        _ratio(right, F.count(F.lit(1))).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    )


def log_loss_accuracy(df: DataFrame, truth: str, prediction: str, truth_probability: Column, group: list[str] = ()) -> DataFrame:
    right = (F.col(truth) == F.col(prediction)).cast("double")
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(right).alias("accuracy"),
        F.avg(-F.log(F.greatest(truth_probability, F.lit(1e-15)))).alias("log_loss"),
    )


# ---------------------------------------------------------------- threshold sweeps

def one_vs_rest(df: DataFrame, truth: str, scores_col: str, classes: list) -> DataFrame:
    """(class, y, score): one row per input row and class, from a score array in class order."""
    cells = [
        F.struct(
            F.lit(c).alias("class"),
            (F.col(truth) == F.lit(c)).cast("long").alias("y"),
            F.get(scores_col, F.lit(i)).cast("double").alias("score"),
        )
        for i, c in enumerate(classes)
    ]
    return df.select(F.inline(F.array(*cells)))


def sweep(scored: DataFrame, group: list[str]) -> DataFrame:
    """Cumulative true/false positives at every distinct score, highest first.

    Input (group, y 0/1, score); output (group, score, tp, fp, pos, neg).  Equal scores form one
    point, so rows collapse before the ordered pass, which runs over range blocks.
    """
    points = scored.groupBy(*group, "score").agg(
        F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_n")
    )
    swept = running_totals(points, group, [F.col("score").desc()], {"tp": "_p", "fp": "_n"}, {"pos": "_p", "neg": "_n"})
    return swept.select(*group, "score", "tp", "fp", "pos", "neg", F.col("_p").alias("step_pos"), F.col("_n").alias("step_neg"))


def roc_points(swept: DataFrame, group: list[str]) -> DataFrame:
    """(group, threshold, fpr, tpr) including the starting point (0, 0) with no threshold."""
    points = swept.select(
        *group, F.col("score").alias("threshold"), _ratio(F.col("fp"), F.col("neg")).alias("fpr"), _ratio(F.col("tp"), F.col("pos")).alias("tpr")
    )
    start = swept.select(*group).distinct().select(
        *group, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def auc(swept: DataFrame, group: list[str]) -> DataFrame:
    """Area under the ROC curve; a class without positives or negatives has none.

    Trapezoids need only each point's own step and its running totals, no neighbour row.
    """
    area = F.sum(F.col("step_neg") * (F.col("tp") - F.col("step_pos") / 2.0))
    whole = F.max(F.col("pos").cast("double") * F.col("neg"))
    return swept.groupBy(*group).agg(F.when(whole > 0, area / whole).alias("auc"))


def _f1(tp: Column, fp: Column, pos: Column) -> Column:
    return _ratio(2.0 * tp, tp + fp + pos)


def best_f1_threshold(swept: DataFrame, group: list[str], ties: str = "highest") -> DataFrame:
    """Threshold with the best F1 (score >= threshold counts as positive); 0/0 counts as 0.

    ``highest`` keeps the highest of equally good thresholds (ROC order), ``lowest`` the lowest
    (precision-recall order).
    """
    scored = swept.withColumn("f1", F.round(_f1(F.col("tp"), F.col("fp"), F.col("pos")), 12))
    tie = F.col("score") if ties == "highest" else -F.col("score")
    best = F.max_by(F.struct("score", "f1"), F.struct("f1", tie.alias("t")))
    return scored.groupBy(*group).agg(best.alias("_b")).select(
        *group, F.col("_b.score").alias("threshold"), F.col("_b.f1").alias("f1")
    )


def pr_curve(swept: DataFrame, group: list[str]) -> DataFrame:
    """(group, threshold, precision, recall) and the end point (1, 0) with no threshold."""
    points = swept.select(
        *group,
        F.col("score").alias("threshold"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("pos")).alias("recall"),
    )
    end = swept.select(*group).distinct().select(
        *group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def weighted_eval(df: DataFrame, truth: str, prediction: str, scores_col: str, classes: list) -> DataFrame:
    """Accuracy, weighted F1/precision/recall and ROC AUC: (metric, value).

    Two classes give the AUC of the second class; more give one-vs-rest AUCs weighted by prevalence.
    """
    metrics = classification_metrics(df, truth, prediction).where(
        F.col("metric").isin("accuracy", "f1_weighted", "precision_weighted", "recall_weighted")
    )
    swept = sweep(one_vs_rest(df, truth, scores_col, classes), ["class"])
    weights = swept.groupBy("class").agg(F.max("pos").alias("w"))
    areas = auc(swept, ["class"]).join(F.broadcast(weights), "class")
    if len(classes) == 2:
        area = areas.where(F.col("class") == F.lit(classes[1])).agg(F.max("auc").alias("value"))
    else:
        area = areas.agg((F.sum(F.col("auc") * F.col("w")) / F.sum("w")).alias("value"))
    return metrics.unionByName(area.select(F.lit("roc_auc").alias("metric"), "value"))


def leaderboard(tables: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Union of metric tables ranked per data set and metric: (dataset, model, metric, value, rank)."""
    parts = [t.select(F.lit(d).alias("dataset"), F.lit(m).alias("model"), "metric", "value") for d, m, t in tables]
    table = reduce(DataFrame.unionByName, parts)
    # one row per model meets in a window
    best_first = Window.partitionBy("dataset", "metric").orderBy(F.round("value", 9).desc())
    return table.withColumn("rank", F.rank().over(best_first))
