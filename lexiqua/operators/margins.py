"""Linear margins of all classes, fitted together: one pass over the rows serves every class.

Each class has its own descent (L-BFGS with backtracking), but a pass evaluates the current aims of
all of them: tasks add up a (classes x features) gradient in numpy, and a tree of partial sums
brings one such block to the driver.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import argmax
from ..plans.staging import stage

MEMORY = 10


class Descent:
    """One class's search: ``aim`` is the point to evaluate, ``told`` takes its value and slope."""

    def __init__(self, size: int, tolerance: float) -> None:
        self.at = self.aim = np.zeros(size)
        self.value, self.slope, self.direction = np.inf, None, None
        self.step, self.past, self.tolerance, self.done = 1.0, [], tolerance, False

    def told(self, value: float, slope: np.ndarray) -> None:
        if self.done:
            return
        if self.slope is not None:
            if value > self.value + 1e-4 * self.step * (self.slope @ self.direction):
                self.step /= 2
                self.done = self.step < 1e-6
                self.aim = self.at if self.done else self.at + self.step * self.direction
                return
            moved, turned = self.aim - self.at, slope - self.slope
            if moved @ turned > 1e-12:
                self.past = [*self.past[1 - MEMORY :], (moved, turned)]
        self.at, self.value, self.slope = self.aim, value, slope
        self.done = np.linalg.norm(slope) <= self.tolerance
        if self.done:
            return
        self.direction = -self._preconditioned(slope)
        self.step = 1.0 if self.past else min(1.0, 1.0 / np.linalg.norm(slope))
        self.aim = self.at + self.step * self.direction

    def _preconditioned(self, slope: np.ndarray) -> np.ndarray:
        out, shares = slope.copy(), []
        for moved, turned in reversed(self.past):
            shares.append(moved @ out / (moved @ turned))
            out -= shares[-1] * turned
        if self.past:
            moved, turned = self.past[-1]
            out *= moved @ turned / (turned @ turned)
        for (moved, turned), share in zip(self.past, reversed(shares)):
            out += (share - turned @ out / (moved @ turned)) * moved
        return out


class Margins:
    """Scores ``features @ weights.T + bias``, one per class; the largest one is the prediction."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray) -> None:
        self.weights, self.bias = weights, bias

    def scored(self, rows: DataFrame) -> DataFrame:
        weights, bias = self.weights, self.bias

        @F.pandas_udf("array<double>")
        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(list(np.stack(x.to_numpy()) @ weights.T + bias)) if len(x) else pd.Series([], dtype=object)

        out = rows.withColumn("scores", margins(vector_to_array("features")))
        return out.select(*rows.columns, argmax(F.col("scores")).cast("double").alias("prediction"), "scores")


def fit_margins(rows: DataFrame, classes: int, reg_param: float = 0.01, max_iter: int = 50, tolerance: float = 1e-3) -> Margins:
    """One against the rest with the squared hinge loss and an L2 penalty on scaled features.

    ``rows`` has label 0..classes-1 and a features vector; each of at most ``max_iter`` passes reads
    all rows.  Features are divided by their deviation, constant ones stay without weight.
    """
    x = stage(rows.select("label", vector_to_array("features").alias("x"), "features"), "margins")
    summary = x.agg(Summarizer.metrics("std", "count").summary(F.col("features")).alias("s")).select("s.std", "s.count").first()
    if not summary["count"]:
        raise ValueError("no rows to train on")
    deviation = summary["std"].toArray()
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    n, size = summary["count"], len(scale)
    plain = x.select("label", "x")
    searches = [Descent(size + 1, tolerance) for _ in range(classes)]
    for _ in range(max_iter):
        aims = np.stack([s.aim for s in searches])

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = aims) -> Iterator[pa.RecordBatch]:
            total = np.zeros((classes, size + 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = np.where(batch.column(0).to_numpy()[:, None] == np.arange(classes), 1.0, -1.0)
                z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * scale
                gap = np.maximum(0.0, 1.0 - y * (z @ w[:, :size].T + w[:, size]))
                pull = -2.0 * gap * y
                total[:, :size] += pull.T @ z
                total[:, size] += pull.sum(axis=0)
                total[:, size + 1] += (gap**2).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = plain.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]))
        sums = parts.treeReduce(operator.add).reshape(classes, size + 2) / n
        penalty = np.where(np.arange(size + 1) < size, reg_param, 0.0)
        for s, w, row in zip(searches, aims, sums):
            s.told(row[-1] + (penalty * w * w).sum() / 2, row[:-1] + penalty * w)
        if all(s.done for s in searches):
            break
    best = np.stack([s.at for s in searches])
    return Margins(best[:, :size] * scale, best[:, size])
