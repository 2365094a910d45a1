"""Classifier training and application as Spark ML jobs; results are tidy tables.

Training loops run on the driver but only see fitted models and scalar losses; rows stay on the
executors and are aggregated there.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from ..functions.numeric import argmax, hash_key, hash_number, predict_with_thresholds
from ..plans.joins import class_values
from ..plans.neighbours import nearest_in_group
from ..plans.ordering import row_positions
from ..plans.staging import stage
from . import evaluation as E
from .corpus import vocabulary
from .features import standard_scaled
from .margins import fit_margins
from .sampling import SEED, random_split, stratified_split, three_way_split
from .topics import Topics, fit_topics  # noqa: F401


# ---------------------------------------------------------------- training tables

@dataclass
class Training:
    """A staged table (id, label 0..k-1, features vector, split) and the meaning of its labels."""

    table: DataFrame
    classes: list
    features: list[str]

    def part(self, split: str) -> DataFrame:
        return self.table.where(F.col("split") == split)


def training_table(
    df: DataFrame,
    id_col: str,
    label_col: str,
    features: list[str] | str,
    split: str = "stratified",
    test_ratio: float = 0.2,
    seed: int = SEED,
) -> Training:
    """Assemble features, number the classes in value order and split the rows.

    ``features`` lists numeric columns and array columns in any mix, or names one array column; an
    array gives one feature per entry, and all rows must have the same number of entries.
    """
    classes = class_values(df, label_col)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label_col)) - 1
    columns = [features] if isinstance(features, str) else list(features)
    arrays = [c for c in columns if isinstance(df.schema[c].dataType, T.ArrayType)]
    sizes = df.agg(*[F.max(F.size(c)).alias(c) for c in arrays]).first() if arrays else {}
    names = [n for c in columns for n in ([f"{c}_{i + 1}" for i in range(sizes[c] or 0)] if c in arrays else [c])]
    shaped = df.select(
        F.col(id_col).alias("id"),
        number.cast("double").alias("label"),
        *[(array_to_vector(F.col(c).cast("array<double>")) if c in arrays else F.col(c)).alias(f"_f{i}") for i, c in enumerate(columns)],
    )
    if columns == arrays and len(arrays) == 1:
        rows = shaped.withColumnRenamed("_f0", "features")
    else:
        inputs = [f"_f{i}" for i in range(len(columns))]
        rows = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(shaped).drop(*inputs)
    if split == "stratified":
        rows = stratified_split(rows, "id", "label", test_ratio, seed)
    elif split == "random":
        rows = random_split(rows, "id", test_ratio, seed)
    elif split == "three_way":
        rows = three_way_split(rows, "id", "label", test_ratio, test_ratio, seed)
    else:
        raise ValueError("split must be 'stratified', 'random' or 'three_way'")
    return Training(stage(rows, "training"), classes, names)


def scored(model: Model, rows: DataFrame, classes: int) -> DataFrame:
    """``rows`` plus prediction and a score array in class order (probabilities where the model has them)."""
    out = model.transform(rows)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*rows.columns, "prediction", vector_to_array(source).alias("scores"))


def metrics_table(predictions: DataFrame, training: Training) -> DataFrame:
    """(split, metric, value): accuracy, F1, precision, recall per split.

    Two classes report the positive class, more report averages of all kinds.
    """
    if len(training.classes) == 2:
        m = E.binary_metrics(predictions, "label", "prediction", 1.0, ["split"])
        names = ("accuracy", "f1", "precision", "recall")
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
        return m.select("split", F.inline(cells))
    return E.classification_metrics(predictions, "label", "prediction", ["split"])


def sweeps(predictions: DataFrame, training: Training) -> DataFrame:
    """Cumulative one-vs-rest sweep of the scores of each class (two classes: the positive one)."""
    numbers = [float(i) for i in range(len(training.classes))]
    points = E.one_vs_rest(predictions, "label", "scores", numbers)
    if len(numbers) == 2:
        points = points.where(F.col("class") == 1.0)
    return E.sweep(points, ["class"])


def importance_table(model: Model, features: list[str], name: str = "model") -> DataFrame:
    """(model, feature, importance), zeros where the model has none."""
    spark = SparkSession.getActiveSession()
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.zeros(len(features))
    rows = [(name, f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


@dataclass
class Report:
    """What one training run yields; the tables are lazy."""

    model: Model
    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    importance: DataFrame
    auc: DataFrame
    thresholds: DataFrame


def run_classifier(training: Training, estimator: Estimator, name: str = "model") -> Report:
    """Fit on the train part, score all parts, and evaluate per split."""
    model = estimator.fit(training.part("train"))
    predictions = scored(model, training.table, len(training.classes))
    test = predictions.where(F.col("split") == "test")
    swept = sweeps(test, training)
    return Report(
        model,
        predictions,
        metrics_table(predictions, training),
        E.cell_counts(predictions, "label", "prediction", ["split"]),
        importance_table(model, training.features, name),
        E.auc(swept, ["class"]),
        E.best_f1_threshold(swept, ["class"], ties="highest"),
    )


# ---------------------------------------------------------------- trees

def grid_search(training: Training, estimator: Estimator, grid: list, folds: int = 5, parallelism: int = 4):
    """Cross-validated choice by accuracy.  Folds come from the row id, so the choice does not depend
    on how the table is partitioned; the candidates' fits run side by side."""
    rows = training.part("train").withColumn("fold", F.pmod(hash_number(F.lit("fold"), F.col("id")), F.lit(folds)).cast("int"))
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism
    )
    return search.fit(rows)


def complexity_sweep(training: Training, strengths: list[float], max_depth: int = 10, seed: int = SEED) -> DataFrame:
    """Tree size and accuracy along a pruning strength (least information gain of a split).

    All trees predict in one pass over the table.
    """
    rows, counts, sizes = training.table, [], []
    train = training.part("train")
    for i, strength in enumerate(strengths):
        tree = DecisionTreeClassifier(minInfoGain=float(strength), maxDepth=max_depth, seed=seed)
        model = tree.fit(train)
        sizes.append((i, float(strength), model.numNodes, model.depth))
        model.setPredictionCol(f"p{i}").setRawPredictionCol("").setProbabilityCol("")
        rows = model.transform(rows)
        hit = (F.col(f"p{i}") == F.col("label")).cast("double")
        counts.append(
            F.struct(
                F.lit(i).alias("step"),
                F.avg(F.when(F.col("split") == "train", hit)).alias("train_accuracy"),
                F.avg(F.when(F.col("split") == "test", hit)).alias("test_accuracy"),
            )
        )
    accuracy = rows.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    trees = rows.sparkSession.createDataFrame(sizes, "step int, strength double, nodes int, depth int")
    return trees.join(accuracy, "step")


@dataclass
class Boosted:
    """SAMME ensemble: weighted vote of trees."""

    models: list
    alphas: list[float]
    classes: int

    def votes(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus one prediction column per tree: a narrow pass, however many trees."""
        for i, m in enumerate(self.models):
            m.setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("")
            rows = m.transform(rows)
        return rows

    def weight(self) -> Column:
        """Weight of a row with votes: every miss multiplies it by exp(alpha)."""
        missed = [F.when(F.col(f"_p{i}") != F.col("label"), F.lit(a)).otherwise(F.lit(0.0)) for i, a in enumerate(self.alphas)]
        return F.exp(reduce(lambda x, y: x + y, missed, F.lit(0.0)))

    def scores(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus prediction and normalised vote shares."""
        total = float(sum(self.alphas)) or 1.0
        shares = []
        for c in range(self.classes):
            mine = [F.when(F.col(f"_p{i}") == float(c), F.lit(a)).otherwise(F.lit(0.0)) for i, a in enumerate(self.alphas)]
            shares.append(reduce(lambda x, y: x + y, mine, F.lit(0.0)) / F.lit(total))
        scored_rows = self.votes(rows).select(*rows.columns, F.array(*shares).alias("scores"))
        return scored_rows.withColumn("prediction", argmax(F.col("scores")).cast("double"))


def fit_adaboost(training: Training, rounds: int = 10, max_depth: int = 1, seed: int = SEED) -> Boosted:
    """Multi-class AdaBoost (Zhu et al. 2009).  Each round fits a tree on rows weighted by the misses
    of the trees before.  A weight follows from those trees' votes on the staged row, so no round
    writes a reweighted table and the lineage never grows beyond one scan."""
    k = len(training.classes)
    boosted = Boosted([], [], k)
    train = training.part("train")
    for i in range(rounds):
        rows = boosted.votes(train).withColumn("weight", boosted.weight()).select("label", "features", "weight")
        model = DecisionTreeClassifier(weightCol="weight", maxDepth=max_depth, seed=seed + i).fit(rows)
        miss = (F.col("prediction") != F.col("label")).cast("double")
        sums = model.transform(rows).agg(F.sum(miss * F.col("weight")).alias("bad"), F.sum("weight").alias("all")).first()
        error = sums["bad"] / sums["all"]
        if error >= 1 - 1 / k:
            break
        boosted.models.append(model)
        boosted.alphas.append(float(np.log((1 - error) / max(error, 1e-10)) + np.log(k - 1)))
        if error <= 0:
            break
    return boosted


# ---------------------------------------------------------------- support vector machines

def fourier_features(rows: DataFrame, size: int, dims: int = 256, gamma: float = 1.0, seed: int = SEED) -> DataFrame:
    """Random features whose inner product approximates an RBF kernel (Rahimi & Recht 2007)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=np.sqrt(2 * gamma), size=(size, dims))
    shift = rng.uniform(0, 2 * np.pi, dims)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            z = np.sqrt(2.0 / dims) * np.cos(np.stack(x.to_numpy()) @ weights + shift)
            yield pd.Series(list(z))

    return rows.withColumn("features", array_to_vector(project(vector_to_array("features"))))


def fit_svm(training: Training, reg_param: float = 0.01, max_iter: int = 50, tune_on: str = "validation"):
    """Linear SVM with F1-optimal thresholds; more than two classes are fitted together, each
    against the rest.

    Thresholds are tuned on the validation part; ``tune_on='test'`` tunes on the rows that are then
    reported, as is often done.  Returns (model, thresholds per class, predictions).
    """
    k = len(training.classes)
    if k == 2:
        model = LinearSVC(regParam=reg_param, maxIter=max_iter).fit(training.part("train"))
        predictions = scored(model, training.table, k)
    else:
        model = fit_margins(training.part("train"), k, reg_param, max_iter)
        predictions = model.scored(training.table)
    predictions = stage(predictions.drop("features"), "svm")
    # few classes; a threshold per class comes to the driver
    tuned = E.best_f1_threshold(sweeps(predictions.where(F.col("split") == tune_on), training), ["class"], ties="lowest")
    found = {int(r["class"]): r["threshold"] for r in tuned.collect()}
    if k == 2:
        custom = (F.col("scores")[1] >= F.lit(found[1])).cast("double")
    else:
        custom = predict_with_thresholds(F.col("scores"), [found[i] for i in range(k)]).cast("double")
    return model, found, predictions.withColumn("thresholded", custom)


# ---------------------------------------------------------------- neural and text classifiers

#: Bytes that solvers running side by side may hold on the driver, and vectors of all weights in each
#: (L-BFGS keeps ten pairs, the point, gradients and a few that are being worked on).
FIT_BYTES, FIT_VECTORS = 256 * 1024 * 1024, 30


def choose_by_validation(training: Training, estimators: dict[str, Estimator], parallelism: int = 4) -> tuple[Model, DataFrame]:
    """Fit every candidate, several at a time, and keep the model with the lowest validation log loss.

    As Spark's solvers hold their vectors on the driver, fewer candidates run side by side the more
    weights they have, and one after the other where one alone takes ``FIT_BYTES``.
    The losses of all candidates come from one scan.  Models without probabilities are refused.
    Returns the model and the losses (candidate, train_loss, validation_loss, chosen).
    """
    spark, train = training.table.sparkSession, training.part("train")

    @inheritable_thread_target(spark)
    def fit(estimator: Estimator) -> Model:
        return estimator.fit(train)

    weights = len(training.features) * len(training.classes) * 8
    with ThreadPoolExecutor(max(1, min(parallelism, FIT_BYTES // max(1, weights * FIT_VECTORS)))) as pool:
        models = dict(zip(estimators, pool.map(fit, estimators.values())))
    rows, losses = training.table.where(F.col("split").isin("train", "validation")), []
    for i, (name, model) in enumerate(models.items()):
        if not model.hasParam("probabilityCol"):
            raise ValueError(f"candidate {name} has no probabilities")
        kept = {p: model.getOrDefault(p) for p in ("predictionCol", "rawPredictionCol", "probabilityCol")}
        model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{i}")
        rows = model.transform(rows)
        model.setPredictionCol(kept["predictionCol"]).setRawPredictionCol(kept["rawPredictionCol"]).setProbabilityCol(kept["probabilityCol"])
        p = F.greatest(F.get(vector_to_array(f"_p{i}"), F.col("label").cast("int")), F.lit(1e-15))
        losses += [F.avg(F.when(F.col("split") == s, -F.log(p))).alias(f"{s}{i}") for s in ("train", "validation")]
    found = rows.agg(*losses).first()
    best = min(range(len(models)), key=lambda i: (found[f"validation{i}"] is None, found[f"validation{i}"] or 0.0))
    table = [(name, found[f"train{i}"], found[f"validation{i}"], i == best) for i, name in enumerate(models)]
    schema = "candidate string, train_loss double, validation_loss double, chosen boolean"
    return list(models.values())[best], spark.createDataFrame(table, schema)


def perceptrons(size: int, classes: int, hidden: int = 32, budgets: tuple[int, ...] = (10, 40, 100), seed: int = SEED) -> dict:
    """The same network trained for several iteration budgets; choosing among them by validation loss
    is early stopping that returns the best weights."""
    return {
        f"iterations={b}": MultilayerPerceptronClassifier(layers=[size, hidden, classes], maxIter=b, seed=seed) for b in budgets
    }


def text_training_table(
    df: DataFrame, id_col: str, tokens_col: str, label_col: str, dims: int | None = None, split: str = "three_way", seed: int = SEED, min_rows: int = 5
) -> Training:
    """Hashed term counts weighted by inverse document frequency fitted on the train part.

    Without ``dims`` the hash range is the power of two above twice the number of terms that
    ``min_rows`` rows hold, so that it grows with the vocabulary; rarer terms share that range.
    """
    # the tokens are read for the vocabulary, the classes and the counts
    df = stage(df.select(id_col, tokens_col, label_col), "tokens")
    if dims is None:
        dims = 1 << min(30, max(10, (2 * vocabulary(df, id_col, tokens_col, min_rows, 1.0).count()).bit_length()))
    classes = class_values(df, label_col)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label_col)) - 1
    hashed = HashingTF(inputCol=tokens_col, outputCol="counts", numFeatures=dims).transform(df)
    rows = hashed.select(F.col(id_col).alias("id"), number.cast("double").alias("label"), "counts")
    rows = three_way_split(rows, "id", "label", seed=seed) if split == "three_way" else stratified_split(rows, "id", "label", seed=seed)
    rows = stage(rows, "counts")
    idf = IDF(inputCol="counts", outputCol="features").fit(rows.where(F.col("split") == "train"))
    table = stage(idf.transform(rows).select("id", "label", "features", "split"), "training")
    return Training(table, classes, [f"hash_{i}" for i in range(dims)])


def logistic_candidates(reg_params: tuple[float, ...] = (0.001, 0.01, 0.1), max_iter: int = 40) -> dict[str, Estimator]:
    return {f"regParam={r}": LogisticRegression(regParam=r, maxIter=max_iter) for r in reg_params}


# ---------------------------------------------------------------- permutation importance

def permutation_importance(
    model: Model, rows: DataFrame, features: list[str], repeats: int = 10, seed: int = SEED
) -> DataFrame:
    """(feature, mean, std): accuracy lost when one feature is shuffled among ``rows``.

    Every repeat pairs each row with the row at the same place of a hash order.  The rows are
    numbered once, all repeats and features are scored by one job, and only the paired row's value
    replaces the shuffled entry.
    """
    # only ids are put in order; feature values join when the pairs are known
    base = rows.select("id", "label", vector_to_array("features").alias("x"))
    places = row_positions(base.select("id"), [], [F.col("id").asc()], "place")
    keyed = base.select("id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).withColumn(
        "key", hash_key(F.lit(seed), F.col("repeat"), F.col("id"))
    )
    shuffled = row_positions(keyed, ["repeat"], [F.col("key").asc()], "place").select(
        "repeat", "place", F.col("id").alias("partner")
    )
    partners = base.select(F.col("id").alias("partner"), F.col("x").alias("y"))
    pairs = places.join(shuffled, "place").join(base, "id").join(partners, "partner")
    mixed = pairs.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))).select(
        "repeat",
        "feature",
        "label",
        array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("feature"), F.get("y", i)).otherwise(v))).alias("features"),
    )
    hit = (F.col("prediction") == F.col("label")).cast("double")
    whole = model.transform(rows).agg(F.avg(hit)).first()[0]
    losses = model.transform(mixed).groupBy("feature", "repeat").agg((F.lit(whole) - F.avg(hit)).alias("loss"))
    names = F.array(*[F.lit(f) for f in features])
    return losses.groupBy("feature").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std")).select(
        F.get(names, F.col("feature")).alias("feature"), "mean", "std"
    )


# ---------------------------------------------------------------- projection and topics

def pca_projection(df: DataFrame, keep: list[str], columns: list[str], n: int = 2) -> DataFrame:
    """Scaled columns projected on their first 2 or 3 principal components: (keep, PC1..PCn)."""
    if n not in (2, 3):
        raise ValueError("n must be 2 or 3")
    rows = VectorAssembler(inputCols=columns, outputCol="v").transform(standard_scaled(df, columns)).select(*keep, "v")
    rows = stage(rows, "scaled")
    projected = PCA(k=n, inputCol="v", outputCol="pc").fit(rows).transform(rows)
    parts = vector_to_array("pc")
    return projected.select(*keep, *[parts[i].alias(f"PC{i + 1}") for i in range(n)])


def word_neighbours(df: DataFrame, tokens_col: str, dims: int = 32, min_count: int = 5, seed: int = 42, parts: int = 4) -> DataFrame:
    """(token, neighbour): closest other word by Word2Vec cosine, for the augmentation.

    ``parts`` tasks sweep a share of the rows each and their vectors are averaged, ``parts`` times
    over.  Their number and the rows of each come from the parameter and hashes of the rows, not from
    the table's partitions; the order in which a share's rows arrive is Spark's, so vectors can
    differ in their last digits from run to run.
    """
    order = F.xxhash64(tokens_col)
    dealt = df.select(tokens_col).repartition(parts, order).sortWithinPartitions(order, F.col(tokens_col))
    model = Word2Vec(inputCol=tokens_col, outputCol="v", vectorSize=dims, minCount=min_count, seed=seed, numPartitions=parts, maxIter=parts).fit(dealt)
    v = vector_to_array("vector")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    vectors = model.getVectors().select("word", F.lit(0).alias("g"), v.alias("v"), norm.alias("n")).where(F.col("n") > 0)
    unit = stage(vectors.select("g", "word", F.transform("v", lambda x: x / F.col("n")).alias("v")), "vectors")
    near = nearest_in_group(unit, unit, "g", "word", "v", 1)
    return near.select(F.col("word").alias("token"), F.col("neighbour_id").alias("neighbour"))
