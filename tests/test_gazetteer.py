"""Gazetteer matches and densities against direct computation."""

import math
import random
import statistics

import numpy as np

from lexiqua.operators.gazetteer import gazetteer_entities
from lexiqua.operators.profile import density_by_category
from lexiqua.plans import joins


def brute(tokens, names):
    at, out = 0, []
    while at < len(tokens):
        best = max((n for n in range(1, len(tokens) - at + 1) if tuple(tokens[at : at + n]) in names), default=0)
        if best:
            words = tuple(tokens[at : at + best])
            out.append((at, best, " ".join(words), names[words]))
        at += best or 1
    return out


def test_longest_leftmost_names(spark, monkeypatch):
    rng = random.Random(6)
    names = [([rng.choice("abc") for _ in range(rng.randint(1, 5))], rng.choice("XYZ")) for _ in range(25)]
    names += [(["a b"], "BLANK"), ([], "EMPTY"), (None, "NONE"), (["q"] * 7, "LONG")]
    best = {}
    for t, kind in names:
        if t:
            best[tuple(t)] = min(kind, best.get(tuple(t), kind))
    docs = [(i, [rng.choice(["a", "b", "c", "d", "q", "a b"]) for _ in range(rng.randint(0, 60))]) for i in range(60)]
    docs += [(60, None), (61, ["q"] * 20), (62, ["d"])]
    frame = spark.createDataFrame(docs, "id long, t array<string>")
    table = spark.createDataFrame(names, "tokens array<string>, type string")
    want = sorted((i, *m) for i, t in docs for m in brute(t or [], best))
    for limit in (joins.BROADCAST_BYTES, -1):
        monkeypatch.setattr(joins, "fits_broadcast", (lambda *a: False) if limit < 0 else joins.fits_broadcast)
        got = gazetteer_entities(frame, "id", "t", table)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert gazetteer_entities(frame, "id", "t", table.limit(0)).count() == 0
    assert gazetteer_entities(frame.limit(0), "id", "t", table).count() == 0


def test_density(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(3, 2, 500), "b": np.r_[np.zeros(60), rng.normal(0, 1, 20)], "c": np.full(9, 4.0), "d": np.array([1.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan")), ("e", None)]
    got = density_by_category(spark.createDataFrame(rows, "k string, x double"), "x", "k", points=80)
    by = {}
    for r in got.collect():
        by.setdefault(r["category"], []).append((r["point"], r["x"], r["density"]))
    assert by.keys() == {"a", "b"}
    for k, points in by.items():
        v, points = values[k], sorted(points)
        q1, q3 = np.quantile(v, [0.25, 0.75])
        s = statistics.stdev(v)
        h = 0.9 * (min(s, (q3 - q1) / 1.34) if q3 > q1 else s) * len(v) ** -0.2
        x, density = np.array([p[1] for p in points]), np.array([p[2] for p in points])
        assert len(points) == 80 and np.isclose(x[0], v.min() - 2 * h) and np.isclose(x[-1], v.max() + 2 * h)
        exact = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        # sharing values between two places is an approximation of second order
        assert np.abs(density - exact).max() < 0.05 * exact.max() and abs(np.trapezoid(density, x) - 1) < 0.05
