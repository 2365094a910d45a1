"""Class lists of any length: TF-IDF by class, category counts, confusion matrices, grids of pairs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiqua.operators.corpus import tfidf_by_class
from lexiqua.operators.evaluation import confusion_matrix
from lexiqua.operators.profile import category_distribution
from lexiqua.plans.joins import every_pair, lookup_join


def brute_tfidf(rows, k):
    """Every (class, term) score, absent terms included."""
    sizes, docs = Counter(c for _, c, _ in rows), len(rows)
    df = defaultdict(Counter)
    for _, c, words in rows:
        df[c].update(set(words))
    total = Counter()
    for c in df:
        total.update(df[c])
    idf = lambda n, d: math.log((1 + n) / (1 + d)) + 1
    own, overall = defaultdict(Counter), Counter()
    for _, c, words in rows:
        n = Counter(words)
        w = {t: x * idf(sizes[c], df[c][t]) for t, x in n.items()}
        v = {t: x * idf(docs, total[t]) for t, x in n.items()}
        for t in n:
            own[c][t] += w[t] / math.sqrt(sum(x * x for x in w.values())) / sizes[c]
            overall[t] += v[t] / math.sqrt(sum(x * x for x in v.values())) / docs
    out = set()
    for c in [*sizes, "all"]:
        scores = overall if c == "all" else own[c]
        ranked = sorted((-(round(scores[t] - overall[t], 6) + 0.0), t, round(scores[t], 6)) for t in total)
        out |= {(c, i, t, s, -d + 0.0) for i, (d, t, s) in enumerate(ranked[:k], 1)}
    return out


@pytest.mark.parametrize("classes, terms, k", [(7, 40, 15), (60, 12, 20), (3, 400, 5)])
def test_tfidf_fills_classes_with_few_terms(spark, classes, terms, k):
    rng = random.Random(classes)
    rows = [(i, f"c{rng.randrange(classes)}", [f"t{int(terms * rng.random() ** 2)}" for _ in range(rng.randint(0, 9))]) for i in range(150)]
    got = tfidf_by_class(spark.createDataFrame([*rows, (999, None, ["t1"])], "id long, c string, t array<string>"), "id", "t", "c", k=k).collect()
    mine = {(r["class"], r["rank"], r["term"], r["score"], r["score_diff"]) for r in got}
    assert {x[:3] for x in mine} == {x[:3] for x in brute_tfidf(rows, k)} and len(mine) == len(got)
    want = {x[:3]: x[3:] for x in brute_tfidf(rows, k)}
    assert all(abs(s - want[c, r, t][0]) < 2e-6 and abs(d - want[c, r, t][1]) < 2e-6 for c, r, t, s, d in mine)


def test_tfidf_of_two_thousand_classes(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("t"), F.pmod(F.xxhash64("id", i), F.lit(3000)).cast("string")))
    df = spark.range(6000).select("id", F.concat(F.lit("c"), F.col("id") % 2000).alias("c"), words.alias("t"))
    counts = tfidf_by_class(df, "id", "t", "c", k=10).groupBy("class").count().collect()
    assert len(counts) == 2001 and {r["count"] for r in counts} == {10}


def test_category_counts_of_twenty_thousand_classes(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("cat"), (F.col("id") % 20_000).alias("c"))
    made = category_distribution(df, "c", "cat")
    assert not any(x in made._jdf.queryExecution().optimizedPlan().toString() for x in ("scalar-subquery", "collect_set", "Cartesian"))
    r = made.where("class <> 'all'").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.count(F.when(F.col("n") == 0, 1)).alias("zeros")).first()
    assert (r["rows"], r["n"]) == (60_000, 40_000) and r["zeros"] == 60_000 - 40_000
    assert made.where("class = 'all'").agg(F.sum("n")).first()[0] == 40_000


def test_confusion_of_many_labels_and_nulls(spark):
    rows = [(str(i % 300), str((i * 7) % 300)) for i in range(900)] + [(None, "1"), ("2", None)]
    got = confusion_matrix(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()
    assert len(got) == 301 * 300 and sum(r["n"] for r in got) == 901
    assert {(r["truth"], r["prediction"]): r["n"] for r in got if r["n"]} == Counter(r for r in rows if r[1] is not None)


def test_every_pair_meets_once(spark):
    left, right = spark.range(37).withColumnRenamed("id", "a"), spark.range(53).withColumnRenamed("id", "b")
    got = every_pair(left, right, block=5).collect()
    assert len(got) == len(set(got)) == 37 * 53 and every_pair(left, right.limit(0)).count() == 0


def test_lookup_with_clashing_columns(spark):
    fact = spark.createDataFrame([(i % 3, i, i, i) for i in range(60)], "k int, _salt int, _parts int, x int")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k int, _facts string")
    for limit in (10**9, -1):
        got = lookup_join(fact, dim, ["k"], ["x"], "left", limit=limit, hot=5)
        assert sorted(got.columns) == ["_facts", "_parts", "_salt", "k", "x"]
        assert {(r["k"], r["x"], r["_salt"], r["_facts"]) for r in got.collect()} == {(i % 3, i, i, {0: "a", 1: "b"}.get(i % 3)) for i in range(60)}
