"""The prefix-tree join against all pairs."""

import random

import numpy as np
import pytest

from lexiqua.llm import prefixtree
from lexiqua.llm.prefixtree import jaccard_components, tree_links


def united(labels, links):
    labels = list(labels)
    for x, y in links:
        a, b = labels[x], labels[y]
        labels = [min(a, b) if k in (a, b) else k for k in labels]
    return labels


@pytest.mark.parametrize("percent", [51, 80, 100])
def test_tree_links_equal_all_pairs(percent):
    rng = random.Random(percent)
    for _ in range(300):
        bases = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(rng.randint(1, 4))]
        sets = []
        for _ in range(rng.randint(2, 14)):
            s = set(rng.choice(bases)) | {rng.randint(0, 60) for _ in range(rng.randint(0, 3))}
            sets.append(set(rng.sample(sorted(s), max(1, len(s) - rng.randint(0, 3)))))
        sizes = np.array([len(s) + rng.choice([0, 0, 1, 2]) for s in sets])
        before = [rng.randint(0, k) if rng.random() < 0.3 else k for k in range(len(sets))]
        before = [before.index(b) for b in before]
        links = tree_links([np.array(sorted(s)) for s in sets], sizes, np.array(before), percent)
        pairs = [
            (x, y) for x in range(len(sets)) for y in range(x)
            if 100 * len(sets[x] & sets[y]) >= percent * (sizes[x] + sizes[y] - len(sets[x] & sets[y]))
        ]
        assert {tuple(sorted(p, reverse=True)) for p in links} <= set(pairs)
        assert united(before, links) == united(before, pairs)


def brute(rows, percent):
    """{id: (sizes, smallest reachable id)} from every pair of texts."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()))
    label = {i: i for i, _ in sets if i is not None}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return sorted((i is None, i or 0, len(s), -1 if i is None else label[i]) for i, s in sets)


def corpus(rng):
    """Near copies of a few texts, a passage that many share, short and empty texts, repeated rows."""
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    license = [word() for _ in range(40)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append(w + (license if rng.random() < 0.4 else []))
    rows += [[word() for _ in range(rng.randint(1, 12))] + license for _ in range(12)]
    rows += [["same", "four", "words"], ["same", "four", "words"], ["Same", "FOUR", "words"], ["one"], []]
    ids = rng.sample(range(1000), len(rows))
    out = [(i, " ".join(w)) for i, w in zip(ids, rows)]
    return out + [out[0], out[3], (out[5][0], out[20][1]), (None, out[1][1]), (1001, None), (1002, "\t\n ")]


@pytest.mark.parametrize("weight", [prefixtree.WEIGHT, 900])
def test_components_equal_all_pairs(spark, monkeypatch, weight):
    monkeypatch.setattr(prefixtree, "WEIGHT", weight)
    rng = random.Random(weight)
    for percent in (80, 60):
        rows = corpus(rng)
        table = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, path int")
        got = jaccard_components(table, percent).collect()
        found = sorted((r[0] is None, r[0] or 0, r[1], -1 if r[2] is None else r[2]) for r in got)
        assert found == brute(rows, percent)


def test_components_without_broadcast(spark, monkeypatch):
    plain = prefixtree.lookup_join
    monkeypatch.setattr(prefixtree, "HOT", 5)
    monkeypatch.setattr(prefixtree, "lookup_join", lambda *a, **k: plain(*a, **{**k, "limit": -1, "hot": 5}))
    rows = corpus(random.Random(9))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1], -1 if r[2] is None else r[2]) for r in got) == brute(rows, 80)


def test_empty_table_and_bounds(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    with pytest.raises(ValueError):
        jaccard_components(empty, 50)
