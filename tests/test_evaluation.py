import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiqua.functions import numeric as N
from lexiqua.operators import evaluation as E
from lexiqua.operators import profile

PRED = "y string, p string"


def metrics(df):
    return {r["metric"]: r["value"] for r in E.classification_metrics(df, "y", "p").collect()}


def test_confusion_has_every_label_pair(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], PRED)
    cells = {(r["truth"], r["prediction"]): r["n"] for r in E.confusion_matrix(df, "y", "p").collect()}
    assert len(cells) == 9 and sum(cells.values()) == 3
    assert cells[("a", "b")] == 1 and cells[("b", "b")] == 0 and cells[("c", "a")] == 1


def test_metrics_by_hand(spark):
    # labels: a (2 right of 3), b (1 right of 1, 1 false), c only predicted, d only true
    rows = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("d", "c")]
    m = metrics(spark.createDataFrame(rows, PRED))
    f1 = {"a": 0.8, "b": 2 / 3, "c": 0.0, "d": 0.0}
    assert m["accuracy"] == pytest.approx(3 / 5) == m["f1_micro"] == m["precision_micro"] == m["recall_micro"]
    assert m["f1_macro"] == pytest.approx(sum(f1.values()) / 4)
    assert m["f1_weighted"] == pytest.approx((3 * 0.8 + 2 / 3) / 5)
    assert m["precision_macro"] == pytest.approx((1 + 0.5) / 4)
    assert m["recall_weighted"] == pytest.approx((3 * 2 / 3 + 1) / 5)


def test_metrics_of_one_class_and_of_nothing(spark):
    assert set(metrics(spark.createDataFrame([("a", "a")], PRED)).values()) == {1.0}
    assert E.confusion_matrix(spark.createDataFrame([], PRED), "y", "p").count() == 0
    assert metrics(spark.createDataFrame([], PRED)) == {} or set(metrics(spark.createDataFrame([], PRED)).values()) == {0.0}


def swept(spark, y, s):
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(y, s)], "class string, y long, score double")
    return E.sweep(df, ["class"])


def test_auc_equals_rank_sum(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 40, 400) / 40
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert E.auc(swept(spark, y, s), ["class"]).first()["auc"] == pytest.approx(want)


def test_sweep_edges(spark):
    # equal scores form one point; without positives the F1 is 0 and there is no AUC
    flat = swept(spark, [1, 0, 1], [0.5, 0.5, 0.5])
    assert flat.count() == 1 and E.auc(flat, ["class"]).first()["auc"] == pytest.approx(0.5)
    none = swept(spark, [0, 0], [0.2, 0.4])
    assert E.auc(none, ["class"]).first()["auc"] is None
    assert E.best_f1_threshold(none, ["class"]).first()["f1"] == 0.0
    assert {(r["precision"], r["recall"]) for r in E.pr_curve(none, ["class"]).collect()} == {(0.0, 0.0), (1.0, 0.0)}


def test_best_threshold_ties(spark):
    # F1 is 2/3 at 0.9 (tp 1 of 2) and at 0.4 (tp 2, fp 2)
    t = swept(spark, [1, 0, 0, 1], [0.9, 0.8, 0.6, 0.4])
    assert E.best_f1_threshold(t, ["class"], "highest").first()["threshold"] == 0.9
    assert E.best_f1_threshold(t, ["class"], "lowest").first()["threshold"] == 0.4


def test_threshold_prediction(spark):
    df = spark.createDataFrame([([0.1, 0.1, 0.1],), ([0.9, 0.9, 0.1],), ([0.9, 0.1, 0.9],), ([0.9, 0.1, 0.1],)], "s array<double>")
    got = [r[0] for r in df.select(N.predict_with_thresholds(F.col("s"), [0.5, 0.5, 0.5])).collect()]
    assert got == [0, 1, 2, 0]


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "l array<double>")
    row = df.select(N.softmax(F.col("l")).alias("p"), N.argmax(F.col("l")).alias("a")).first()
    assert row["p"] == pytest.approx([0.5, 0.5, 0.0]) and row["a"] == 0


def test_polarity_is_strict(spark):
    df = spark.createDataFrame([(-0.34,), (-0.33,), (0.33,), (0.34,)], "s double")
    assert [r[0] for r in df.select(N.polarity(F.col("s"))).collect()] == ["negative", "neutral", "neutral", "positive"]


def test_outliers(spark):
    rows = [(float(i), 5.0, False) for i in range(20)] + [(500.0, 5.0, False), (600.0, 5.0, True), (None, 5.0, False)]
    df = spark.createDataFrame(rows, "a double, b double, keep boolean")
    kept, removed = profile.remove_outliers(df, ["a", "b"], keep_col="keep")
    assert kept.count() == 21 and [r["removed"] for r in removed.orderBy("step").collect()] == [2, 0]
    kept, removed = profile.remove_outliers(df, ["a"], mode="independent")
    assert kept.count() == 20
    with pytest.raises(ValueError):
        profile.remove_outliers(df, ["a"], mode="other")


def test_sequential_outliers_depend_on_the_order(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(x * x)) for x in a], "a double, b double")
    one = profile.remove_outliers(df, ["a", "b"])[0].count()
    x = a
    for values in (lambda v: v, lambda v: v * v):
        w = values(x)
        q1, q3 = np.quantile(w, [0.25, 0.75])
        x = x[(w >= q1 - 1.5 * (q3 - q1)) & (w <= q3 + 1.5 * (q3 - q1))]
    assert one == len(x)


def test_histogram_of_a_single_value(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "c string, x double")
    rows = profile.score_histogram(df, "c", "x", 20).collect()
    assert {(r["class"], r["bin"], r["n"]) for r in rows} == {("a", 10, 2), ("all", 10, 2)}


def test_scaling_a_constant_column(spark):
    from lexiqua.operators.features import standard_scaled

    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    assert [tuple(r) for r in standard_scaled(df, ["a", "b"]).collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_confusion_matrix_of_many_and_missing_labels(spark):
    wide = spark.range(60).select((F.col("id") % 40).alias("t"), F.col("id").alias("p"))
    assert E.confusion_matrix(wide, "t", "p").count() == 60 * 60
    odd = spark.createDataFrame([("a", "b"), ("a", None), (None, "b")], "t string, p string")
    got = {(r["truth"], r["prediction"]): r["n"] for r in E.confusion_matrix(odd, "t", "p").collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0, (None, "a"): 0, (None, "b"): 1}
    assert E.confusion_matrix(odd.limit(0), "t", "p").count() == 0


def test_categories_of_two_thousand_classes(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("c"), (F.col("id") % 3).alias("k"))
    out = profile.category_distribution(df, "c", "k")
    assert out.count() == 3 * 2001 and out.where("class <> 'all'").agg(F.sum("n")).first()[0] == 4000
