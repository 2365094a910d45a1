"""The queries on models return the models' own figures; their audits stand beside them."""

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from lexiqua.operators import models as M
from lexiqua.registry import models as R

CURVES = "part name value"
COLUMNS = {
    "tree_classifier": CURVES,
    "tree_grid_search": "max_depth min_rows accuracy best",
    "tree_complexity_sweep": "step strength nodes depth train_accuracy test_accuracy",
    "random_forest": CURVES,
    "feature_importance": "model feature importance",
    "boosted_trees": CURVES,
    "boosted_trees_multiclass": CURVES,
    "adaboost": "split metric value",
    "svm_classifier": "kernel kind split metric value",
    "mlp_embeddings": "split metric value",
    "text_classifier": "metric value",
    "batch_predictions": "vec_id prediction spark_prob external_prob",
    "permutation_importance": "feature mean std",
    "pca_projection": "vec_id label PC1 PC2 PC3",
    "lda_topics": "topic rank term weight",
    "dominant_topic": "doc_id topic share",
    "augmented_word_vectors": None,
}


@pytest.fixture(scope="module")
def results(spark, small):
    made = {}

    def get(key):
        if key not in made:
            df = queries()[key](spark, small)
            made[key] = (df.columns, df.collect())
        return made[key]

    return get


@pytest.mark.parametrize("key", COLUMNS)
def test_returns_figures(results, key):
    columns, rows = results(key)
    assert COLUMNS[key] is None or columns == COLUMNS[key].split()
    assert rows and key not in oracle_sql() and f"{key}_audit" in oracle_sql()
    values = [v for r in rows for v in r if isinstance(v, float)]
    assert key == "augmented_word_vectors" or len(set(values)) > 1


def test_tree_accuracy_is_that_of_its_predictions(spark, small, results):
    t = R._text_training(spark, small, "random")
    model = DecisionTreeClassifier(maxDepth=5, seed=R.SEED).fit(t.part("train"))
    scored = M.scored(model, t.table, 2)
    want = {r["split"]: r["a"] for r in scored.groupBy("split").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).collect()}
    got = {(r["part"], r["name"]): r["value"] for r in results("tree_classifier")[1]}
    assert all(got[(s, "accuracy")] == pytest.approx(a) for s, a in want.items()) and ("auc", "1.0") in got and ("threshold", "1.0") in got


def test_svm_metrics_of_every_kernel_kind_and_split(results):
    accuracy = {tuple(r[:3]): r["value"] for r in results("svm_classifier")[1] if r["metric"] == "accuracy"}
    assert len(accuracy) == 2 * 2 * 3 and all(0 <= v <= 1 for v in accuracy.values())


def test_grid_marks_its_best_candidate(results):
    rows = results("tree_grid_search")[1]
    assert len(rows) == 6 and [r["accuracy"] for r in rows if r["best"]] == [max(r["accuracy"] for r in rows)]


def test_augmented_texts_come_along(results):
    columns, rows = results("augmented_word_vectors")
    assert "text" in columns and any(r["is_new"] for r in rows) and any(r["text"] for r in rows)
