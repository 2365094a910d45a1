"""Trees beyond the built-in estimators: second-order boosting and the pruning path of a fitted tree.

Boosting follows Chen and Guestrin 2016: features are cut into bins at sketched quantiles once, and a
level of all classes' trees is one job that sums gradients and hessians per (class, node, feature,
bin), map-side first, and picks each node's best split.  The driver keeps the trees, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import fresh_path, stage

SEED = 12345
#: Key under which a level's job sums the log loss.
_LOSS = -1


@dataclass
class Tree:
    """Nodes in heap order (children of k at 2k + 1 and 2k + 2); feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that every row of bins reaches within ``levels`` steps."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosting:
    """Rounds of one tree per class over binned features; softmax of the summed leaf values."""

    edges: list[np.ndarray]
    classes: int
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1) if self.edges else x.astype(np.int64)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += tree.value[tree.places(bins, self.depth)]
        return out

    def scores(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a vector column ``features``) plus prediction and the class probabilities."""
        names = rows.columns
        schema = T.StructType([*rows.drop("features").schema.fields, T.StructField("prediction", T.DoubleType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])
        kept = [n for n in names if n != "features"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = _softmax(self.margins(self.binned(_matrix(batch.column(len(kept))))))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), self.classes).cast(pa.list_(pa.float64()))
                    columns = [batch.column(i) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(p.argmax(axis=1).astype(float)), lists], names=[*kept, "prediction", "scores"])

        return rows.select(*kept, vector_to_array("features").alias("x")).mapInArrow(run, schema)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _softmax(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _level_sums(rows: DataFrame, model: Boosting, trees: list[Tree], level: int, bins: int) -> DataFrame:
    """(key, g, h): sums per class, node of the level, feature and bin; the loss under its own key."""
    nodes, classes, width = 2**level, model.classes, len(model.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = classes * nodes * width * bins
        sums, loss, seen = np.zeros((2, size)), 0.0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            label, x = batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1)).astype(np.int64)
            p = _softmax(model.margins(x))
            loss -= np.log(np.maximum(p[np.arange(len(label)), label], 1e-15)).sum()
            for c, tree in enumerate(trees):
                at = tree.places(x, level) - (nodes - 1)
                mine = at >= 0
                g, h = (p[:, c] - (label == c))[mine], (p[:, c] * (1 - p[:, c]))[mine]
                keys = (((c * nodes + at[mine])[:, None] * width + np.arange(width)) * bins + x[mine]).ravel()
                for k, v in enumerate((g, h)):
                    sums[k] += np.bincount(keys, np.repeat(v, width), size)
        if seen:
            used = np.flatnonzero(sums[1])
            keys = np.r_[used, _LOSS]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.r_[sums[0][used], loss]), pa.array(np.r_[sums[1][used], 0.0])], names=["key", "g", "h"])

    return rows.select("label", "bins").mapInArrow(run, "key long, g double, h double").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _best_splits(sums: DataFrame, width: int, bins: int, penalty: float, least: float, price: float) -> list:
    """One row per (class, node): its best split, or its sums alone where none pays; and the loss."""
    place = F.col("key")
    named = sums.select(
        F.floor(place / (width * bins)).alias("node"), (F.floor(place / bins) % width).alias("feature"), (place % bins).alias("bin"), "g", "h"
    )
    upto = Window.partitionBy("node", "feature").orderBy("bin")
    whole = Window.partitionBy("node", "feature")
    cut = named.select(
        "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h")
    )
    left, right = F.col("gl") ** 2 / (F.col("hl") + penalty), (F.col("g") - F.col("gl")) ** 2 / (F.col("h") - F.col("hl") + penalty)
    gain = 0.5 * (left + right - F.col("g") ** 2 / (F.col("h") + penalty)) - price
    pays = (F.col("hl") >= least) & (F.col("h") - F.col("hl") >= least) & (F.col("node") >= 0)
    order = F.struct(F.when(pays, F.round(gain, 12)).otherwise(F.lit(float("-inf"))).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "g", "h")
    return cut.groupBy("node").agg(F.max(order).alias("s")).select("node", "s.*").collect()


def fit_newton_boosting(
    train: DataFrame, classes: int, rounds: int = 10, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0, price: float = 0.0, bins: int = 32
) -> Boosting:
    """Second-order gradient boosting of a staged table (label 0..classes-1, vector features).

    ``rate`` shrinks the leaves, ``penalty`` is their squared weight's, ``least`` the least hessian
    sum of a child, ``price`` what a split must gain.  ``losses`` are the mean log losses before
    each round and after the last.
    """
    arrays = train.select("label", vector_to_array("features").alias("x"))
    first = arrays.select(F.size("x").alias("n")).first()
    width = first["n"] if first else 0
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    sketch = arrays.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col("x")[i], probs, F.lit(10_000)).alias(f"q{i}") for i in range(width)]).first()
    model = Boosting([np.unique(np.array(sketch[f"q{i}"] or [], float)) for i in range(width)], classes, depth)
    rows = sketch["n"]
    if not rows:
        return model

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = pa.FixedSizeListArray.from_arrays(pa.array(model.binned(_matrix(batch.column(1))).astype(np.int16).ravel()), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(pa.list_(pa.int16()))], names=["label", "bins"])

    binned = stage(arrays.mapInArrow(cut, "label double, bins array<smallint>"), "binned")
    for _ in range(rounds):
        trees = [Tree.empty(depth) for _ in range(classes)]
        for level in range(depth):
            found = _best_splits(_level_sums(binned, model, trees, level, bins), width, bins, penalty, least, price)
            for r in found:
                if r["node"] < 0:
                    if level == 0:
                        model.losses.append(r["g"] / rows)
                    continue
                tree, at = trees[int(r["node"]) // 2**level], 2**level - 1 + int(r["node"]) % 2**level
                tree.value[at] = -rate * r["g"] / (r["h"] + penalty)
                if r["gain"] > 0:
                    tree.feature[at], tree.cut[at] = -r["f"], -r["b"]
                    for child, g, h in ((2 * at + 1, r["gl"], r["hl"]), (2 * at + 2, r["g"] - r["gl"], r["h"] - r["hl"])):
                        tree.value[child] = -rate * g / (h + penalty)
        model.rounds.append(trees)
    last = _level_sums(binned, model, [Tree.empty(depth)] * 0, 0, bins).where(F.col("key") == _LOSS).first()
    model.losses.append(last["g"] / rows)
    return model


# ------------------------------------------------------------------ pruning

@dataclass
class Subtree:
    """One tree of a pruning path: strength, size, depth, summed leaf impurity, hits per split."""

    alpha: float
    nodes: int
    depth: int
    impurity: float
    hits: dict[str, float]


def node_counts(model: DecisionTreeClassificationModel, table: DataFrame) -> tuple[dict, dict]:
    """(children, counts) of a fitted tree: {node: (left, right)} of the inner nodes, and per node
    {(split, label): rows}, from one scan that gives every row its leaf."""
    path = fresh_path(table.sparkSession, "tree")
    model.write().save(path)
    rows = table.sparkSession.read.parquet(f"{path}/data").select("id", "leftChild", "rightChild").collect()
    children = {r["id"]: (r["leftChild"], r["rightChild"]) for r in rows if r["leftChild"] >= 0}
    # leaves are numbered as nodes are, from left to right
    leaves = sorted(r["id"] for r in rows if r["leftChild"] < 0)
    model = model.copy().setLeafCol("leaf").setPredictionCol("_p").setRawPredictionCol("").setProbabilityCol("")
    counted = model.transform(table.select("label", "split", "features")).groupBy("leaf", "split", "label").agg(F.count(F.lit(1)).alias("n"))
    counts: dict = {r["id"]: {} for r in rows}
    for r in counted.collect():
        counts[leaves[int(r["leaf"])]][r["split"], int(r["label"])] = r["n"]

    def fill(node: int) -> dict:
        for child in children.get(node, ()):
            for key, n in fill(child).items():
                counts[node][key] = counts[node].get(key, 0) + n
        return counts[node]

    fill(0)
    return children, counts


def pruning_path(children: dict, counts: dict, train: str = "train") -> list[Subtree]:
    """Weakest-link pruning (Breiman et al. 1984): the nested subtrees from the whole tree to its root.

    The cost of a node is its Gini impurity times its share of the training rows.  Each step collapses
    the inner nodes whose cost grows least per leaf saved; that growth is the step's ``alpha``.
    """
    total = sum(n for (s, _), n in counts[0].items() if s == train)

    def cost(node: int) -> float:
        mine = [n for (s, _), n in counts[node].items() if s == train]
        size = sum(mine)
        return (size - sum(n * n for n in mine) / size) / total if size else 0.0

    costs = {node: cost(node) for node in counts}
    inner, out, alpha = dict(children), [], 0.0

    def measure(node: int, depth: int, links: dict) -> tuple[float, int, int, dict]:
        """(leaf costs, leaves, depth, hits) below a node; ``links`` gets every inner node's growth."""
        if node not in inner:
            mine = {label: n for (s, label), n in counts[node].items() if s == train}
            guess = min(mine, key=lambda c: (-mine[c], c)) if mine else 0
            return costs[node], 1, depth, {s: n for (s, label), n in counts[node].items() if label == guess}
        below = [measure(child, depth + 1, links) for child in inner[node]]
        impurity, leaves = sum(b[0] for b in below), sum(b[1] for b in below)
        links[node] = max(0.0, (costs[node] - impurity) / (leaves - 1))
        hits: dict = {}
        for b in below:
            for s, n in b[3].items():
                hits[s] = hits.get(s, 0) + n
        return impurity, leaves, max(b[2] for b in below), hits

    while True:
        links: dict = {}
        impurity, leaves, depth, hits = measure(0, 0, links)
        if links and min(links.values()) <= alpha + 1e-12:
            # costs nothing at the present strength
            weak = [n for n, g in links.items() if g <= alpha + 1e-12]
        else:
            out.append(Subtree(alpha, 2 * leaves - 1, depth, impurity, hits))
            if not links:
                return out
            alpha = min(links.values())
            weak = [n for n, g in links.items() if g <= alpha + 1e-12]
        for node in weak:
            inner.pop(node, None)


def pruned_accuracies(train: DataFrame, table: DataFrame, steps: int = 20, max_depth: int = 10, seed: int = SEED) -> DataFrame:
    """(step, alpha, nodes, depth, impurity, train_accuracy, test_accuracy) of up to ``steps`` subtrees,
    evenly spaced along the pruning path of one tree; every figure comes from one set of counts."""
    children, counts = node_counts(DecisionTreeClassifier(maxDepth=max_depth, seed=seed).fit(train), table)
    path = pruning_path(children, counts)
    chosen = sorted({round(i) for i in np.linspace(0, len(path) - 1, min(steps, len(path)))})
    sizes = {s: sum(n for (t, _), n in counts[0].items() if t == s) for s in ("train", "test")}
    rows = []
    for step, t in enumerate(path[i] for i in chosen):
        accuracy = [t.hits.get(s, 0) / sizes[s] if sizes[s] else None for s in ("train", "test")]
        rows.append((step, float(t.alpha), t.nodes, t.depth, float(t.impurity), *accuracy))
    return table.sparkSession.createDataFrame(rows, "step int, alpha double, nodes int, depth int, impurity double, train_accuracy double, test_accuracy double")
