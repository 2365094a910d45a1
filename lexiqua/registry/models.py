"""Seeded model training on the test tables.

No SQL can fit a model, so the queries with a model's own figures have no oracle.  Beside each of
them stands an audit, ``<query>_audit``, that returns what SQL can state about the same fit: which
rows and ids went into every split and class, that each got a valid prediction or score, and that
the model does no worse on its training rows than always naming their largest class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import boosting, corpus, evaluation, features, models as M
from ..plans.staging import spread, stage
from .base import SQL_TERM, documents, labelled, query, sql_key, table, tokenized
from .corpus import SQL_PICKS

SEED = 12345
TEXT_FEATURES = ["n_chars", "n_tokens", "root_ttr", "digits", "capitals", "lines"]


def _text_numbers(spark, sf_dir):
    """Numeric features of every document."""
    words = X.tokens(F.col("text"))
    size = F.greatest(F.length("text"), F.lit(1))
    measured = documents(spark, sf_dir).select("doc_id", "n_chars", "text", words.alias("tokens"))
    return measured.select(
        "doc_id",
        "n_chars",
        F.size("tokens").alias("n_tokens"),
        X.root_ttr(F.col("tokens")).alias("root_ttr"),
        (F.regexp_count("text", F.lit("[0-9]")) / size).alias("digits"),
        (F.regexp_count("text", F.lit("[A-Z]")) / size).alias("capitals"),
        F.regexp_count("text", F.lit("\n")).alias("lines"),
    )


def text_numbers(spark, sf_dir):
    """Numeric features of the labelled documents and their quality.

    The numbers are taken before the join, so no text is shuffled.
    """
    return labelled(spark, sf_dir, _text_numbers(spark, sf_dir)).drop("toxic")


def _text_training(spark, sf_dir, split="stratified"):
    return M.training_table(text_numbers(spark, sf_dir), "doc_id", "quality", TEXT_FEATURES, split)


def _vector_training(spark, sf_dir, split="stratified"):
    return M.training_table(spread(table(spark, sf_dir, "embeddings")), "vec_id", "label", "embedding", split)


def _curves(report):
    """Metrics per split, AUC and best thresholds of one run as (part, name, value)."""
    m = report.metrics.select(F.col("split").alias("part"), F.col("metric").alias("name"), "value")
    a = report.auc.select(F.lit("auc").alias("part"), F.col("class").cast("string").alias("name"), F.col("auc").alias("value"))
    t = report.thresholds.select(F.lit("threshold").alias("part"), F.col("class").cast("string").alias("name"), F.col("threshold").alias("value"))
    return m.unionByName(a).unionByName(t)


def _audit(predictions, classes, *by):
    """(by, split, label, n, id_sum, valid, learned) of scored rows (by, id, label, split, prediction)."""
    guess = F.col("prediction")
    counted = predictions.groupBy(*by, "split", F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("id").alias("id_sum"),
        F.count(F.when((guess >= 0) & (guess < classes) & (guess == F.floor(guess)), 1)).alias("valid"),
        F.count(F.when(guess == F.col("label"), 1)).alias("hits"),
    )
    # one row per split and class is left here
    whole = Window.partitionBy(*by, "split")
    learned = (F.col("split") != "train") | (F.sum("hits").over(whole) >= F.max("n").over(whole))
    return counted.select(*by, "split", "label", "n", "id_sum", "valid", learned.alias("learned"))


_TEXT = "SELECT doc_id AS id, quality AS y FROM documents JOIN labels USING (doc_id)"
_VECTOR = "SELECT vec_id AS id, label AS y FROM embeddings"
_LANG = "SELECT doc_id AS id, lang AS y FROM documents"


def _sql_audit(source: str, split: str, extra: str = "", cross: str = "") -> str:
    key = sql_key("12345", "id")
    cut = {
        "random": f"CASE WHEN {key} < '33333333' THEN 'test' ELSE 'train' END",
        "stratified": "CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END",
        "three_way": """CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test'
  WHEN r <= floor(n * 0.2::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END""",
    }[split]
    return f"""WITH r AS (SELECT id, dense_rank() OVER (ORDER BY y) - 1 AS label, row_number() OVER (PARTITION BY y ORDER BY {key}) AS r,
  count(*) OVER (PARTITION BY y) AS n FROM ({source})),
p AS (SELECT id, label::INTEGER AS label, {cut} AS split FROM r),
a AS (SELECT split, label, count(*) AS n, sum(id)::BIGINT AS id_sum, count(*) AS valid, true AS learned FROM p GROUP BY split, label)
SELECT a.*{extra} FROM a {cross}"""


def _tree(spark, sf_dir):
    t = _text_training(spark, sf_dir, "random")
    return M.run_classifier(t, DecisionTreeClassifier(maxDepth=5, seed=SEED), "tree")


@query("tree_classifier")
def tree_classifier(spark, sf_dir):
    return _curves(_tree(spark, sf_dir))


@query("tree_classifier_audit", _sql_audit(_TEXT, "random"))
def tree_classifier_audit(spark, sf_dir):
    return _audit(_tree(spark, sf_dir).predictions, 2)


def _tree_grid(spark, sf_dir):
    t = _text_training(spark, sf_dir)
    tree = DecisionTreeClassifier(seed=SEED)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [2, 4, 6]).addGrid(tree.minInstancesPerNode, [1, 10]).build()
    return t, tree, grid, M.grid_search(t, tree, grid)


@query("tree_grid_search")
def tree_grid_search(spark, sf_dir):
    _, tree, grid, search = _tree_grid(spark, sf_dir)
    rows = [
        (int(g[tree.maxDepth]), int(g[tree.minInstancesPerNode]), float(a), i == int(np.argmax(search.avgMetrics)))
        for i, (g, a) in enumerate(zip(grid, search.avgMetrics))
    ]
    return spark.createDataFrame(rows, "max_depth int, min_rows int, accuracy double, best boolean")


@query("tree_grid_winner")
def tree_grid_winner(spark, sf_dir):
    """Metrics of the winning candidate, fitted on all training rows, on train and test."""
    t, _, _, search = _tree_grid(spark, sf_dir)
    return M.metrics_table(stage(M.scored(search.bestModel, t.table, len(t.classes)), "predictions"), t)


@query("tree_grid_search_audit", _sql_audit(_TEXT, "stratified", ", 6 AS candidates"))
def tree_grid_search_audit(spark, sf_dir):
    t, _, _, search = _tree_grid(spark, sf_dir)
    # the winner, fitted on all training rows, is scored on train and test
    audit = _audit(M.scored(search.bestModel, t.table, len(t.classes)), len(t.classes))
    return audit.withColumn("candidates", F.lit(len(search.avgMetrics)))


@query("tree_complexity_sweep")
def tree_complexity_sweep(spark, sf_dir):
    return M.complexity_sweep(_text_training(spark, sf_dir, "random"), list(np.linspace(0.0, 0.095, 20)))


@query("tree_complexity_sweep_audit", "SELECT i::INTEGER AS step, round(i * 0.005::DOUBLE, 3) AS strength, true AS plausible FROM range(20) t(i)")
def tree_complexity_sweep_audit(spark, sf_dir):
    swept = tree_complexity_sweep(spark, sf_dir)
    fair = F.col("train_accuracy").between(0.5, 1.0) & F.col("test_accuracy").between(0.0, 1.0) & (F.col("nodes") >= 1)
    return swept.select("step", F.round("strength", 3).alias("strength"), fair.alias("plausible"))


@query("tree_pruning_path")
def tree_pruning_path(spark, sf_dir):
    t = _text_training(spark, sf_dir, "random")
    return boosting.pruned_accuracies(t.part("train"), t.table)


@query(
    "tree_stump_counts",
    f"""WITH r AS (SELECT doc_id, (n_chars >= 1500)::INTEGER AS label, (length(replace(text, ' ', '')) >= 1250)::INTEGER AS x,
  CASE WHEN {sql_key('12345', 'doc_id')} < '33333333' THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT node, split, label, count(*) AS n FROM (SELECT 0 AS node, * FROM r UNION ALL SELECT 1 + x, * FROM r) GROUP BY ALL""",
)
def tree_stump_counts(spark, sf_dir):
    """Rows per node, split and class of a tree of one split: long texts by their characters without blanks."""
    d = documents(spark, sf_dir).withColumn("label", (F.col("n_chars") >= 1500).cast("int"))
    d = d.withColumn("solid", (F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 1250).cast("double"))
    t = M.training_table(d, "doc_id", "label", ["solid"], split="random")
    _, counts = boosting.node_counts(DecisionTreeClassifier(maxDepth=1, seed=SEED).fit(t.part("train")), t.table)
    rows = [(node, split, label, n) for node, cells in counts.items() for (split, label), n in cells.items()]
    return spark.createDataFrame(rows, "node int, split string, label int, n long")


def _newton(spark, sf_dir):
    t = _vector_training(spark, sf_dir)
    return t, boosting.fit_newton_boosting(t.part("train"), len(t.classes))


@query("newton_boosting")
def newton_boosting(spark, sf_dir):
    """Metrics of each split, and the mean log loss of the training rows before and after every round."""
    t, model = _newton(spark, sf_dir)
    m = M.metrics_table(stage(model.scores(t.table), "predictions"), t).select(F.col("split").alias("part"), F.col("metric").alias("name"), "value")
    losses = [("loss", str(i), float(x)) for i, x in enumerate(model.losses)]
    return m.unionByName(spark.createDataFrame(losses, "part string, name string, value double"))


@query("newton_boosting_audit", _sql_audit(_VECTOR, "stratified"))
def newton_boosting_audit(spark, sf_dir):
    t, model = _newton(spark, sf_dir)
    return _audit(model.scores(t.table), len(t.classes))


def _forest(spark, sf_dir):
    t = _vector_training(spark, sf_dir)
    return t, M.run_classifier(t, RandomForestClassifier(numTrees=30, maxDepth=6, seed=SEED), "forest")


@query("random_forest")
def random_forest(spark, sf_dir):
    return _curves(_forest(spark, sf_dir)[1])


@query("random_forest_audit", _sql_audit(_VECTOR, "stratified"))
def random_forest_audit(spark, sf_dir):
    t, report = _forest(spark, sf_dir)
    return _audit(report.predictions, len(t.classes))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    t = _text_training(spark, sf_dir)
    return M.run_classifier(t, RandomForestClassifier(numTrees=30, seed=SEED), "forest").importance.orderBy(F.col("importance").desc(), "feature")


@query("feature_importance_audit", f"SELECT unnest({TEXT_FEATURES}) AS feature, true AS plausible, 1.0::DOUBLE AS total")
def feature_importance_audit(spark, sf_dir):
    found = feature_importance(spark, sf_dir)
    total = F.round(F.sum("importance").over(Window.partitionBy("model")), 6)
    return found.select("feature", F.col("importance").between(0.0, 1.0).alias("plausible"), total.alias("total"))


def _boosted(spark, sf_dir):
    t = _text_training(spark, sf_dir)
    return M.run_classifier(t, GBTClassifier(maxIter=15, maxDepth=3, seed=SEED), "gbt")


@query("boosted_trees")
def boosted_trees(spark, sf_dir):
    return _curves(_boosted(spark, sf_dir))


@query("boosted_trees_audit", _sql_audit(_TEXT, "stratified"))
def boosted_trees_audit(spark, sf_dir):
    return _audit(_boosted(spark, sf_dir).predictions, 2)


def _boosted_languages(spark, sf_dir):
    """One boosted model per language on the text numbers."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    size = F.greatest(F.length("text"), F.lit(1))
    shares = {"th": "th", "umlaut": "[äöüß]", "acute_o": "[óñí]", "grave": "[èêç]"}
    counted = d.select("doc_id", "lang", *[(F.regexp_count("text", F.lit(p)) / size).alias(n) for n, p in shares.items()])
    t = M.training_table(counted, "doc_id", "lang", list(shares))
    one = OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=SEED), parallelism=4)
    return t, M.run_classifier(t, one, "gbt")


@query("boosted_trees_multiclass")
def boosted_trees_multiclass(spark, sf_dir):
    return _curves(_boosted_languages(spark, sf_dir)[1])


@query("boosted_trees_multiclass_audit", _sql_audit(_LANG, "stratified"))
def boosted_trees_multiclass_audit(spark, sf_dir):
    t, report = _boosted_languages(spark, sf_dir)
    return _audit(report.predictions, len(t.classes))


def _adaboost(spark, sf_dir):
    t = _text_training(spark, sf_dir)
    return t, M.fit_adaboost(t, rounds=10).scores(t.table)


@query("adaboost")
def adaboost(spark, sf_dir):
    t, predictions = _adaboost(spark, sf_dir)
    return M.metrics_table(predictions, t)


@query("adaboost_audit", _sql_audit(_TEXT, "stratified"))
def adaboost_audit(spark, sf_dir):
    return _audit(_adaboost(spark, sf_dir)[1], 2)


def _svm(spark, sf_dir):
    """Predictions of a linear and a kernel-approximating SVM on the vectors, plain and thresholded."""
    t = _vector_training(spark, sf_dir, "three_way")
    lifted = M.Training(stage(M.fourier_features(t.table, len(t.features)), "fourier"), t.classes, [f"z{i}" for i in range(256)])
    parts = []
    for name, training in (("linear", t), ("rbf", lifted)):
        _, _, predictions = M.fit_svm(training, max_iter=20)
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("prediction")) for k in ("prediction", "thresholded")])
        parts.append(predictions.select(F.lit(name).alias("kernel"), "id", "label", "split", F.inline(kinds)))
    return t, parts[0].unionByName(parts[1])


@query("svm_classifier")
def svm_classifier(spark, sf_dir):
    return evaluation.classification_metrics(_svm(spark, sf_dir)[1], "label", "prediction", ["kernel", "kind", "split"])


@query("svm_classifier_audit", _sql_audit(_VECTOR, "three_way", ", kernel, kind", "CROSS JOIN (VALUES ('linear'), ('rbf')) k(kernel) CROSS JOIN (VALUES ('prediction'), ('thresholded')) l(kind)"))
def svm_classifier_audit(spark, sf_dir):
    t, predictions = _svm(spark, sf_dir)
    return _audit(predictions, len(t.classes), "kernel", "kind")


@query("mixed_features", _sql_audit("SELECT e.vec_id AS id, e.label AS y FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id", "stratified", ", n_features", "CROSS JOIN (SELECT max(len(embedding)) + 6 AS n_features FROM embeddings)"))
def mixed_features(spark, sf_dir):
    """A vector and engineered columns in one model input: embeddings next to numbers of the same id's text."""
    numbers = _text_numbers(spark, sf_dir).withColumnRenamed("doc_id", "vec_id")
    both = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").join(numbers, "vec_id")
    t = M.training_table(both, "vec_id", "label", ["embedding", *TEXT_FEATURES])
    audit = _audit(M.run_classifier(t, RandomForestClassifier(numTrees=20, maxDepth=6, seed=SEED), "forest").predictions, len(t.classes))
    return audit.withColumn("n_features", F.lit(len(t.features)))


def _mlp(spark, sf_dir):
    t = _vector_training(spark, sf_dir, "three_way")
    model, losses = M.choose_by_validation(t, M.perceptrons(len(t.features), len(t.classes)))
    return t, M.scored(model, t.table, len(t.classes)), losses


@query("mlp_embeddings")
def mlp_embeddings(spark, sf_dir):
    t, predictions, losses = _mlp(spark, sf_dir)
    lost = losses.select(F.lit("validation").alias("split"), F.col("candidate").alias("metric"), F.col("validation_loss").alias("value"))
    return M.metrics_table(predictions, t).unionByName(lost)


@query("mlp_embeddings_audit", _sql_audit(_VECTOR, "three_way", ", 3 AS candidates"))
def mlp_embeddings_audit(spark, sf_dir):
    t, predictions, losses = _mlp(spark, sf_dir)
    return _audit(predictions, len(t.classes)).withColumn("candidates", F.lit(losses.count()).cast("int"))


def _text_model(spark, sf_dir):
    t = M.text_training_table(tokenized(spark, sf_dir, "lang"), "doc_id", "tokens", "lang")
    model, losses = M.choose_by_validation(t, M.logistic_candidates())
    return t, model, losses


@query("text_classifier")
def text_classifier(spark, sf_dir):
    t, model, losses = _text_model(spark, sf_dir)
    predictions = stage(M.scored(model, t.part("test"), len(t.classes)).drop("features"), "predictions")
    m = evaluation.weighted_eval(predictions, "label", "prediction", "scores", [float(i) for i in range(len(t.classes))])
    return m.unionByName(losses.select(F.col("candidate").alias("metric"), F.col("validation_loss").alias("value")))


@query("text_classifier_audit", _sql_audit(_LANG, "three_way", ", 3 AS candidates"))
def text_classifier_audit(spark, sf_dir):
    t, model, losses = _text_model(spark, sf_dir)
    return _audit(M.scored(model, t.table, len(t.classes)), len(t.classes)).withColumn("candidates", F.lit(losses.count()).cast("int"))


def _both_probabilities(spark, sf_dir):
    """Probabilities of a Spark model next to those of an external scorer run on Arrow batches."""
    t = _vector_training(spark, sf_dir)
    model = LogisticRegression(regParam=0.01, maxIter=30).fit(t.part("train"))
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def load():
        def score(batch: pd.DataFrame) -> pd.Series:
            z = np.stack(batch["x"].to_numpy()) @ weights.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            return pd.Series(list(p / p.sum(axis=1, keepdims=True)), index=batch.index)

        return score

    # the external scorer runs on the rows the Spark model has scored, so nothing is joined
    inside = M.scored(model, t.table, len(t.classes)).select("id", "prediction", vector_to_array("features").alias("x"), F.col("scores").alias("p"))
    return features.score_batches(inside, load, "q")


@query("batch_predictions")
def batch_predictions(spark, sf_dir):
    both = _both_probabilities(spark, sf_dir)
    return both.select(
        F.col("id").alias("vec_id"), "prediction", F.round(F.array_max("p"), 6).alias("spark_prob"), F.round(F.array_max("q"), 6).alias("external_prob")
    )


@query("batch_predictions_audit", "SELECT vec_id, true AS agrees, 1.0::DOUBLE AS total FROM embeddings")
def batch_predictions_audit(spark, sf_dir):
    both = _both_probabilities(spark, sf_dir)
    apart = F.aggregate(F.zip_with("p", "q", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    return both.select(F.col("id").alias("vec_id"), (apart < 1e-9).alias("agrees"), F.round(total, 6).alias("total"))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    t = _text_training(spark, sf_dir)
    model = RandomForestClassifier(numTrees=20, seed=SEED).fit(t.part("train"))
    return M.permutation_importance(model, t.part("test"), t.features, repeats=10)


@query("permutation_importance_audit", f"SELECT unnest({TEXT_FEATURES}) AS feature, true AS plausible")
def permutation_importance_audit(spark, sf_dir):
    found = permutation_importance(spark, sf_dir)
    return found.select("feature", (F.col("mean").between(-1.0, 1.0) & (F.col("std") >= 0)).alias("plausible"))


@query("pca_projection")
def pca_projection(spark, sf_dir):
    e = features.embedding_columns(spread(table(spark, sf_dir, "embeddings")), "embedding")
    columns = [c for c in e.columns if c.startswith("col_embedding_")]
    return M.pca_projection(e, ["vec_id", "label"], columns, 3)


@query("pca_projection_audit", "SELECT vec_id, label, true AS finite FROM embeddings")
def pca_projection_audit(spark, sf_dir):
    parts = pca_projection(spark, sf_dir)
    return parts.select("vec_id", "label", (F.abs(F.col("PC1") + F.col("PC2") + F.col("PC3")) < 1e6).alias("finite"))


# ---------------------------------------------------------------- topics

@query("lda_topics")
def lda_topics(spark, sf_dir):
    return M.fit_topics(tokenized(spark, sf_dir), "doc_id", "tokens", k=10, passes=5).terms(10)


_SQL_KNOWN = f"""{SQL_TERM}, df AS (SELECT w, count(DISTINCT doc_id) AS df FROM term GROUP BY w),
known AS MATERIALIZED (SELECT w FROM df WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM documents))"""


@query("lda_topics_audit", f"WITH {_SQL_KNOWN} SELECT count(DISTINCT w) AS terms, count(*)::DOUBLE AS tokens FROM term JOIN known USING (w)")
def lda_topics_audit(spark, sf_dir):
    """What the topics hold beyond the prior is every token of the vocabulary, each once."""
    model = M.fit_topics(tokenized(spark, sf_dir), "doc_id", "tokens", k=10, passes=5)
    mass = F.aggregate("lambda", F.lit(0.0), lambda a, x: a + x) - model.k * model.eta
    return model.weights.agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum(mass), 3).alias("tokens"))


@query("dominant_topic")
def dominant_topic(spark, sf_dir):
    t = M.fit_topics(tokenized(spark, sf_dir), "doc_id", "tokens", k=10, passes=5).dominant()
    return t.select(F.col("id").alias("doc_id"), "topic", "share")


@query("dominant_topic_audit", f"WITH {_SQL_KNOWN} SELECT doc_id, count(*)::DOUBLE AS tokens FROM term JOIN known USING (w) GROUP BY doc_id")
def dominant_topic_audit(spark, sf_dir):
    """What a document's topics hold beyond the prior is its tokens of the vocabulary."""
    model = M.fit_topics(tokenized(spark, sf_dir), "doc_id", "tokens", k=10, passes=5)
    mass = F.aggregate("gamma", F.lit(0.0), lambda a, x: a + x) - model.k * model.alpha
    return model.documents().select(F.col("id").alias("doc_id"), F.round(mass, 3).alias("tokens"))


@query("augmented_word_vectors")
def augmented_word_vectors(spark, sf_dir):
    """Augmentation that replaces words by their closest word vector."""
    t = stage(tokenized(spark, sf_dir, "lang"), "tokens")
    neighbours = M.word_neighbours(t, "tokens")
    return corpus.balanced_corpus(t, "doc_id", "tokens", "lang", neighbours)


@query("augmented_word_vectors_audit", f"""WITH {SQL_TERM}, {SQL_PICKS}
SELECT p.lang, copy, doc_id AS source_id, true AS is_new, len(tokens)::INTEGER AS n_tokens FROM pick p JOIN tok USING (doc_id) WHERE len(tokens) > 0
UNION ALL SELECT lang, NULL, doc_id, false, len(tokens)::INTEGER FROM tok""")
def augmented_word_vectors_audit(spark, sf_dir):
    made = augmented_word_vectors(spark, sf_dir)
    n = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    return made.select("lang", "copy", "source_id", "is_new", n.alias("n_tokens"))
