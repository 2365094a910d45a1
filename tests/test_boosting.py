"""Second-order boosting and pruning paths against plain implementations."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lexiqua.operators.boosting import fit_newton_boosting, node_counts, pruned_accuracies, pruning_path


def vectors(spark, x, y, split=None):
    rows = [(i, float(c), v.tolist(), "train" if split is None else split[i]) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, label double, v array<double>, split string")
    return df.select("id", "label", array_to_vector("v").alias("features"), "split")


def plain_round(bins, y, margins, classes, depth, rate, penalty, least):
    """The margins after one more round, found by trying every split of every node."""
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    out = margins.copy()
    for c in range(classes):
        g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

        def grow(rows, level):
            best = (0.0, None)
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
            for f in range(bins.shape[1]) if level < depth else ():
                for b in range(bins[:, f].max() + 1):
                    left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if h[left].sum() >= least and h[right].sum() >= least:
                        gain = 0.5 * (score(left) + score(right) - score(rows))
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
            if best[1] is None:
                out[rows, c] += -rate * g[rows].sum() / (h[rows].sum() + penalty)
            else:
                for side in best[1]:
                    grow(side, level + 1)

        grow(np.arange(len(y)), 0)
    return out


def test_rounds_equal_a_plain_implementation(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(240, 3)), 2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + 0.3 * x[:, 2] > 0.5)
    train = vectors(spark, x, y).repartition(5)
    model = fit_newton_boosting(train, 3, rounds=3, depth=2, bins=8)
    bins, margins, losses = model.binned(x), np.zeros((240, 3)), []

    def loss(m):
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(240), y]).mean()

    for _ in range(3):
        losses.append(loss(margins))
        margins = plain_round(bins, y, margins, 3, 2, 0.3, 1.0, 1.0)
    assert np.allclose(model.margins(bins), margins, atol=1e-8)
    assert np.allclose(model.losses, [*losses, loss(margins)]) and math.isclose(model.losses[0], math.log(3))
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    scored = model.scores(train).collect()
    assert np.mean([r["prediction"] == r["label"] for r in scored]) > 0.8 and all(abs(sum(r["scores"]) - 1) < 1e-9 for r in scored)


def test_nothing_to_split(spark):
    same = fit_newton_boosting(vectors(spark, np.ones((30, 2)), [0, 1] * 15), 2, rounds=2)
    assert same.losses[-1] == pytest.approx(math.log(2)) and all((t.feature < 0).all() for r in same.rounds for t in r)
    assert fit_newton_boosting(vectors(spark, np.ones((30, 2)), [0, 1] * 15).where(F.lit(False)), 2).rounds == []


def brute_path(children, counts):
    """Every step from the definition: the cheapest inner node per leaf saved, one after the other."""
    train = {n: [k for (s, _), k in c.items() if s == "train"] for n, c in counts.items()}
    total = sum(train[0])
    cost = {n: (sum(c) - sum(k * k for k in c) / sum(c)) / total if c else 0.0 for n, c in train.items()}
    inner, out = dict(children), []

    def leaves(n):
        return [n] if n not in inner else [x for c in inner[n] for x in leaves(c)]

    def reachable(n):
        return [n] if n not in inner else [n, *[x for c in inner[n] for x in reachable(c)]]

    alpha = 0.0
    while True:
        growth = {n: (cost[n] - sum(cost[x] for x in leaves(n))) / (len(leaves(n)) - 1) for n in reachable(0) if n in inner}
        if not growth or min(growth.values()) > alpha + 1e-12:
            out.append((round(alpha, 10), len(reachable(0)), round(sum(cost[x] for x in leaves(0)), 10)))
            if not growth:
                return out
            alpha = min(growth.values())
        inner.pop(min(growth, key=lambda n: (growth[n], n)))


def test_pruning_path_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)) + (rng.random(400) < 0.15).astype(int)
    split = ["test" if rng.random() < 0.3 else "train" for _ in range(400)]
    table = vectors(spark, x, y, split)
    train = table.where("split = 'train'")
    model = DecisionTreeClassifier(maxDepth=6, seed=1).fit(train)
    children, counts = node_counts(model, table)
    assert sum(counts[0].values()) == 400 and len(counts) == model.numNodes
    path = pruning_path(children, counts)
    assert [(round(t.alpha, 10), t.nodes, round(t.impurity, 10)) for t in path] == brute_path(children, counts)
    assert [t.nodes for t in path] == sorted({t.nodes for t in path}, reverse=True) and path[-1].nodes == 1
    # the subtree with nothing pruned by force hits what the model hits
    hit = model.transform(table).where("prediction = label").groupBy("split").count().collect()
    if path[0].nodes == model.numNodes:
        assert path[0].hits == {r["split"]: r["count"] for r in hit}
    rows = pruned_accuracies(train, table, steps=4, max_depth=6).collect()
    assert [r["step"] for r in rows] == [0, 1, 2, 3] and rows[0]["train_accuracy"] >= rows[-1]["train_accuracy"] and rows[-1]["depth"] == 0
