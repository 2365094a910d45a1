import threading

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from lexiqua.operators import models as M
from lexiqua.operators.margins import Descent


@pytest.fixture(scope="module")
def blobs(spark):
    """Three separable classes, one of them holding half of the rows; the last column is noise."""
    rng = np.random.default_rng(7)
    centre = {"a": (0, 0), "b": (4, 0), "c": (0, 4)}
    rows = []
    for i in range(400):
        c = "a" if i % 2 else ("b" if i % 4 else "c")
        rows.append((i, c, *(rng.normal(size=2) + centre[c]).tolist(), float(rng.normal())))
    df = spark.createDataFrame([(r[0], r[1], float(r[2]), float(r[3]), r[4]) for r in rows], "id long, c string, x double, y double, n double")
    return df.cache()


def accuracy(predictions, split):
    return predictions.where(F.col("split") == split).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def test_run_classifier_report(blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y", "n"])
    tree = DecisionTreeClassifier(maxDepth=4, seed=1)
    report = M.run_classifier(t, tree)
    assert t.classes == ["a", "b", "c"]
    assert accuracy(report.predictions, "train") > 0.9 and accuracy(report.predictions, "test") > 0.85
    m = {(r["split"], r["metric"]): r["value"] for r in report.metrics.collect()}
    assert m[("test", "f1_micro")] == pytest.approx(m[("test", "accuracy")])
    assert all(0.5 < r["auc"] <= 1 for r in report.auc.collect()) and report.thresholds.count() == 3
    assert report.confusion.agg(F.sum("n")).first()[0] == 400
    imp = {r["feature"]: r["importance"] for r in report.importance.collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and imp["n"] < 0.1
    again = M.run_classifier(t, tree).predictions
    assert again.join(report.predictions.select("id", F.col("prediction").alias("q")), "id").where("prediction <> q").count() == 0


def test_probabilities_sum_to_one(blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y"])
    p = M.scored(LogisticRegression(maxIter=10).fit(t.part("train")), t.table, 3)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    assert p.where(F.abs(total - 1) > 1e-9).count() == 0


def test_adaboost_beats_one_stump(blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y", "n"])
    one = M.fit_adaboost(t, rounds=1, max_depth=1).scores(t.table)
    many = M.fit_adaboost(t, rounds=8, max_depth=1)
    assert len(many.models) == len(many.alphas) > 1
    assert accuracy(many.scores(t.table), "test") > accuracy(one, "test")


def test_svm_and_kernel(spark, blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y"], "three_way")
    _, thresholds, p = M.fit_svm(t, max_iter=20)
    assert set(thresholds) == {0, 1, 2} and accuracy(p, "test") > 0.85
    rng = np.random.default_rng(8)
    ring = [(i, "in" if i % 2 else "out", *(np.array([np.cos(a), np.sin(a)]) * (1.0 if i % 2 else 3.0)).tolist()) for i, a in enumerate(rng.uniform(0, 6.3, 300))]
    df = spark.createDataFrame([(r[0], r[1], float(r[2]), float(r[3])) for r in ring], "id long, c string, x double, y double")
    r = M.training_table(df, "id", "c", ["x", "y"], "three_way")
    lifted = M.Training(M.fourier_features(r.table, 2, dims=64, gamma=0.5), r.classes, [])
    assert accuracy(M.fit_svm(lifted, max_iter=20)[2], "test") > 0.95


def test_descent_finds_the_minimum():
    scale, best = np.array([1.0, 10.0, 100.0]), np.array([3.0, -2.0, 1.0])
    d = Descent(3, 1e-8)
    for _ in range(60):
        d.told(float((scale * (d.aim - best) ** 2).sum()), 2 * scale * (d.aim - best))
    assert d.done and np.allclose(d.at, best)


def test_array_and_columns_make_one_input(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0], float(-i)) for i in range(20)], "id long, c int, v array<double>, x double")
    t = M.training_table(df, "id", "c", ["v", "x"])
    assert t.features == ["v_1", "v_2", "x"]
    assert {r["id"]: r["features"].toArray().tolist() for r in t.table.collect()}[7] == [7.0, 1.0, -7.0]


def test_hash_range_grows_with_the_vocabulary(spark):
    rows = [(i, [f"w{(i * 7 + j) % 3000}" for j in range(40)], i % 2) for i in range(400)]
    t = M.text_training_table(spark.createDataFrame(rows, "id long, t array<string>, c int"), "id", "t", "c")
    assert len(t.features) > 2000 and t.table.first()["features"].size == len(t.features)


def test_candidates_without_probabilities_are_refused(blobs):
    t = M.training_table(blobs.where("c <> 'c'"), "id", "c", ["x", "y"], "three_way")
    with pytest.raises(ValueError):
        M.choose_by_validation(t, {"svm": LinearSVC(maxIter=2)})


def test_grid_search_prefers_depth(blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y"])
    tree = DecisionTreeClassifier(seed=1)
    search = M.grid_search(t, tree, ParamGridBuilder().addGrid(tree.maxDepth, [1, 4]).build(), folds=3)
    assert search.avgMetrics[1] > search.avgMetrics[0] and search.bestModel.depth > 1


def test_complexity_sweep_shrinks(blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y", "n"], "random")
    rows = M.complexity_sweep(t, [0.0, 0.05, 0.5]).orderBy("step").collect()
    assert [r["nodes"] for r in rows] == sorted((r["nodes"] for r in rows), reverse=True) and rows[-1]["nodes"] == 1
    assert rows[0]["train_accuracy"] > rows[-1]["train_accuracy"]


def test_choice_by_validation(blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y"], "three_way")
    model, losses = M.choose_by_validation(t, M.logistic_candidates((0.01, 10.0), 20))
    rows = {r["candidate"]: r for r in losses.collect()}
    assert rows["regParam=0.01"]["chosen"] and not rows["regParam=10.0"]["chosen"]
    assert model.getRegParam() == 0.01


def test_permutation_importance(blobs):
    t = M.training_table(blobs, "id", "c", ["x", "y", "n"])
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(t.part("train"))
    rows = {r["feature"]: r for r in M.permutation_importance(model, t.part("test"), t.features, 5).collect()}
    assert set(rows) == {"x", "y", "n"} and rows["x"]["mean"] > 0.1 > abs(rows["n"]["mean"]) and rows["x"]["std"] >= 0


def test_pca(spark, blobs):
    out = M.pca_projection(blobs, ["id"], ["x", "y", "n"], 2)
    assert out.columns == ["id", "PC1", "PC2"]
    s = out.agg(F.stddev_pop("PC1").alias("a"), F.stddev_pop("PC2").alias("b"), F.corr("PC1", "PC2").alias("c")).first()
    assert s["a"] >= s["b"] and abs(s["c"]) < 1e-6
    with pytest.raises(ValueError):
        M.pca_projection(blobs, ["id"], ["x", "y"], 4)


def test_topics_of_empty_rows(spark):
    docs = [(i, ["cat", "dog", "pet"] if i % 2 else ["sun", "sky", "rain"]) for i in range(40)] + [(40, []), (41, ["once"])]
    df = spark.createDataFrame(docs, "id long, t array<string>")
    topics = M.fit_topics(df, "id", "t", k=2, passes=5, no_above=0.9)
    assert set(topics.vocabulary) == {"cat", "dog", "pet", "sun", "sky", "rain"}
    got = {r["id"]: (r["topic"], r["share"]) for r in topics.dominant().collect()}
    assert got[40] == got[41] == (0, 0.5) and len(got) == 42
    assert topics.terms(3).count() == 6


def test_word_neighbours_are_stable_over_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [f"{'abc'[i % 3]}{w}" for w in rng.integers(0, 5, 30)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    for dealt in (df.coalesce(1), df.repartition(5), df.repartition(40, "id")):
        found = M.word_neighbours(dealt, "t", dims=8).collect()
        assert len(found) == 15 and all(r["token"][0] == r["neighbour"][0] for r in found)


def test_many_weights_are_fitted_one_after_the_other(blobs, monkeypatch):
    """Solvers keep their vectors on the driver; as many as there are candidates ran side by side before."""
    running, most, lock = [], [], threading.Lock()

    class Counted(LogisticRegression):
        def fit(self, *a, **k):
            with lock:
                running.append(1)
                most.append(len(running))
            try:
                return super().fit(*a, **k)
            finally:
                with lock:
                    running.pop()

    t = M.training_table(blobs, "id", "c", ["x", "y"], "three_way")
    monkeypatch.setattr(M, "FIT_BYTES", 2 * 3 * 8 * M.FIT_VECTORS)
    candidates = {str(r): Counted(regParam=r, maxIter=5) for r in (0.01, 0.1, 1.0)}
    _, alone = M.choose_by_validation(t, candidates)
    assert max(most) == 1 and len(most) == 3
    monkeypatch.undo()
    _, together = M.choose_by_validation(t, candidates)
    assert alone.collect() == together.collect()
