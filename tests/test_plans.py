from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiqua.operators import corpus
from lexiqua.plans import joins, neighbours, ordering
from lexiqua.plans.staging import stage


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_running_totals(spark, partitions):
    rng = np.random.default_rng(1)
    # one group holds most rows; a NULL group is a group of its own
    g = [None if x < 0.1 else ("hot" if x < 0.8 else "cold") for x in rng.random(3000)]
    pdf = pd.DataFrame({"g": g, "k": rng.permutation(3000), "v": rng.integers(0, 5, 3000)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, k long, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.running_totals(df, ["g"], [F.col("k").desc()], {"t": "v"}, {"all": "v"}).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(out) == 3000
    for _, part in out.groupby("g", dropna=False):
        part = part.sort_values("k", ascending=False)
        assert (part["t"] == part["v"].cumsum()).all() and (part["all"] == part["v"].sum()).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    hot = np.where(rng.random(40000) < 0.4, 7.0, rng.normal(size=40000) * 10)
    few = np.array([1.0, 2.0, 3.0, 10.0])
    sizes = {f"n{n}": rng.integers(0, 9, n).astype(float) for n in (1, 2, 3, 5, 6, 7, 11, 50)}
    rows = [("hot", float(x)) for x in hot] + [("few", float(x)) for x in few] + [("few", None), ("few", float("nan")), ("none", float("nan"))]
    rows += [(None, float(x)) for x in few] + [(g, float(x)) for g, xs in sizes.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "p": 0.95, "z": 1.0}
    got = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], "x", probs).collect()}
    assert "none" not in got
    for g, x in (("hot", hot), ("few", few), (None, few), *sizes.items()):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p), abs=1e-9), (g, name)
    empty = ordering.exact_quantiles(df.where("false"), [], "x", {"m": 0.5}).collect()
    assert [r["m"] for r in empty] == [None]


def test_flag_by_hash_sizes(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") == 7, "one").when(F.col("id") % 3 == 0, "third").otherwise("rest").alias("c"))
    keyed = df.withColumn("k", F.md5(F.col("id").cast("string")))
    rules = {"none": lambda n: F.lit(0), "half": lambda n: F.floor(n / 2), "all": lambda n: n, "more": lambda n: n + 5}
    out = ordering.flag_by_hash(keyed, ["c"], "k", rules).toPandas()
    for _, part in out.groupby("c"):
        assert not part["none"].any() and part["all"].all() and part["more"].all()
        assert part["half"].sum() == len(part) // 2
        assert part.loc[part["half"], "k"].max() <= part.loc[~part["half"], "k"].min() if part["half"].any() else True


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_broadcast(spark, how):
    fact = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = stage(spark.createDataFrame([("hot", 1), ("3", 2), ("x", 3)], "k string, v int"))
    a = joins.lookup_join(fact, dim, ["k"], ["id"], how).orderBy("id").collect()
    b = joins.lookup_join(fact, dim, ["k"], ["id"], how, limit=-1, hot=50).orderBy("id").collect()
    assert a == b and len(a) == (1334 if how == "inner" else 2000)


def test_token_lookup_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c"])], "id int, t array<string>")
    dim = stage(spark.createDataFrame([("a", 1.0), ("b", 4.0)], "term string, s double"))

    def total():
        return {r[0]: r[1] for r in joins.token_lookup(df, ["id"], "t", dim, ["id"]).groupBy("id").agg(F.sum(F.col("s") * F.col("n"))).collect()}

    want = total()
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    assert want == total() == {1: 6.0}


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    out = joins.top_k(df, ["g"], [F.col("v").desc()], 1500)
    assert out.count() == 3000 and out.agg(F.min("v")).first()[0] == 2000


def test_numbered_copies(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 25)], "k string, n long")
    out = joins.numbered_copies(df, "n", "i", chunk=10).toPandas()
    assert sorted(out.loc[out.k == "c", "i"]) == list(range(25)) and len(out) == 28


def test_class_values_refuses_many(spark):
    with pytest.raises(ValueError):
        joins.class_values(spark.range(50), "id", limit=20)


@pytest.mark.parametrize("chunk", [16, 2048])
def test_nearest_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 4))
    v[40:90] = v[40]  # a third of the rows are copies of one point
    g = ["x"] * 120 + ["y"] * 28 + ["z", "w"]
    df = spark.createDataFrame([(g[i], i, v[i].tolist()) for i in range(150)], "g string, i long, v array<double>")
    got = neighbours.nearest_in_group(df, df, "g", "i", "v", 5).toPandas()
    for i in range(150):
        d = [(round(float(np.linalg.norm(v[i] - v[j])), 9), j) for j in range(150) if j != i and g[j] == g[i]]
        mine = got[got["i"] == i].sort_values("rank")
        assert list(zip(mine["distance"].round(9), mine["neighbour_id"])) == sorted(d)[:5]


@pytest.mark.parametrize("n", [2, 3, 4])
def test_corpus_ngrams_over_short_rows(spark, monkeypatch, n):
    monkeypatch.setattr(corpus, "HALO_BLOCK", 7)
    rng = np.random.default_rng(n)
    docs = [[f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 4))] for _ in range(120)]
    groups = ["a" if rng.random() < 0.7 else "b" for _ in docs]
    df = spark.createDataFrame([(i, g, d) for i, (g, d) in enumerate(zip(groups, docs))], "id long, g string, t array<string>")
    want = {}
    for g in "ab":
        stream = [w for d, c in zip(docs, groups) if c == g for w in d]
        for i in range(len(stream) - n + 1):
            key = (g, *stream[i : i + n])
            want[key] = want.get(key, 0) + 1
    got = corpus.ngram_counts(df, "id", "t", n, ["g"], "corpus").collect()
    assert {tuple(r)[:-1]: r["n"] for r in got} == want


def test_cooccurrence_is_symmetric_and_skips_equals(spark):
    df = spark.createDataFrame([(["a", "a", "b", "c"],), ([],), (["a"],)], "t array<string>")
    got = {(r["token"], r["context"]): r["n"] for r in corpus.cooccurrence(df, "t", 2).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}


def test_detect_language_without_letters(spark):
    train = spark.createDataFrame([("en", ["the", "then"]), ("de", ["der", "dann"])], "lang string, t array<string>")
    profiles = corpus.language_profiles(train, "t", "lang")
    df = spark.createDataFrame([(1, ["the"]), (2, []), (3, ["dann"]), (4, ["ж"])], "id int, t array<string>")
    got = {r["id"]: r["detected"] for r in corpus.detect_language(df, "id", "t", profiles).collect()}
    # a lone foreign letter shares no gram with the profiles
    assert got == {1: "en", 2: "xxx", 3: "de", 4: "xxx"}


def test_lookup_join_splits_only_hot_keys(spark):
    fact = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).when(F.col("id") < 1100, None).otherwise(F.col("id")).alias("k"))
    dim = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    for how in ("inner", "left"):
        plain = fact.join(dim, "k", how)
        split = joins.lookup_join(fact, dim, ["k"], ["id"], how, limit=-1, hot=300)
        assert sorted(map(str, split.select("k", "id", "v").collect())) == sorted(map(str, plain.select("k", "id", "v").collect()))


def test_width_counts_nested_values(spark):
    rows = [(["x" * 100, None], ("y" * 50, 1), {"k": "z" * 30}), (None, None, None)]
    df = spark.createDataFrame(rows, "a array<string>, s struct<t:string,n:int>, m map<string,string>")
    bytes_ = 100 + 50 + 30 + 1
    assert not joins.fits_broadcast(df, bytes_) and joins.fits_broadcast(df, bytes_ + 500)
    assert not joins.fits_broadcast(spark.range(1000).select(F.array(F.repeat(F.lit("x"), F.lit(1000))).alias("a")), 1_000_000)


def test_a_local_folder_is_refused_on_a_cluster():
    from lexiqua.plans.staging import check_shared

    for master, root in (("local[8]", "file:/tmp/w"), ("yarn", "hdfs://n/w"), ("spark://n:7077", "s3a://b/w")):
        check_shared(root, master)
    for root in ("file:/tmp/w", "file:///tmp/w", "/tmp/w"):
        with pytest.raises(ValueError):
            check_shared(root, "spark://n:7077")


def test_known_counts_split_keys_and_change_no_row(spark):
    fact = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = stage(spark.createDataFrame([("hot", 1), ("3", 2), ("x", 3)], "k string, v int"))
    want = joins.lookup_join(fact, dim, ["k"], ["id"]).orderBy("id").collect()
    for n in (1, 1333, 10**6):
        known = spark.createDataFrame([("hot", n)], "k string, _facts long")
        assert joins.lookup_join(fact, dim, ["k"], ["id"], limit=-1, hot=50, counts=known).orderBy("id").collect() == want
    # helper columns of the same name are renamed, known counts with them
    clash = joins.lookup_join(fact.withColumn("_salt", F.lit(1)), dim, ["k"], ["id"], limit=-1, hot=50, counts=joins.key_counts(fact, ["k"]))
    assert clash.drop("_salt").orderBy("id").collect() == want


def _tables(calls, monkeypatch, module):
    """Notes the columns of every ``fact`` that lookups count by themselves."""
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    real = joins.key_counts
    monkeypatch.setattr(joins, "key_counts", lambda df, on: calls.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, on))


@pytest.mark.parametrize("scope", ["corpus", "document"])
def test_collocations_count_ngrams_once(spark, monkeypatch, scope):
    """Beside words too many to broadcast, each lookup computed all n-grams once more to find its hot words."""
    rows = [(i, list("abcabdab") if i % 2 else ["a", "b", "c", "a"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    want = corpus.collocations(df, "id", "t", 3, scope=scope).collect()
    calls = []
    _tables(calls, monkeypatch, corpus)
    found = corpus.collocations(df, "id", "t", 3, scope=scope)
    assert found.collect() == want and len(want) > 3
    assert "inline" not in found._jdf.queryExecution().optimizedPlan().toString() and not any("inline" in c for c in calls)


def test_tfidf_counts_no_bag_of_words_for_hot_terms(spark, monkeypatch):
    rows = [(i, "xyz"[i % 3], ["aa", "bb", f"c{i % 5}", "aa"]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, c string, t array<string>")
    of = lambda d: sorted((*r[:-1], round(r[-1], 9)) for r in d.collect())
    by_class = lambda: of(corpus.tfidf_by_class(df, "id", "t", "c", 4).drop("rank"))
    want = of(corpus.tfidf_overall(df, "id", "t")), by_class()
    calls = []
    _tables(calls, monkeypatch, corpus)
    assert (of(corpus.tfidf_overall(df, "id", "t")), by_class()) == want
    assert not any("explode(t" in c for c in calls)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_in_many_dimensions_over_short_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "LONG_CHUNK", 24)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(160, 12)).astype(np.float32).astype(np.float64) + 1000  # far from the origin
    v[100:120] = v[100]
    names = [f"w{i:03d}" for i in range(160)]
    df = spark.createDataFrame([("x", n, row.tolist()) for n, row in zip(names, v)], f"g string, i string, v array<{kind}>")
    v = np.array([r["v"] for r in df.orderBy("i").collect()])
    got = neighbours.nearest_in_group(df, df, "g", "i", "v", 3).toPandas()
    for i, name in enumerate(names):
        d = [(round(float(np.linalg.norm(v[i] - v[j])), 9), names[j]) for j in range(160) if j != i]
        mine = got[got["i"] == name].sort_values("rank")
        assert list(zip(mine["distance"].round(9), mine["neighbour_id"])) == sorted(d)[:3]


def test_a_vector_travels_to_a_first_pivot_once(spark, monkeypatch):
    seen, visit = [], neighbours._visit

    def counted(visits, *rest):
        seen.append((visits.count(), visits.select("_cell").distinct().count()))
        return visit(visits, *rest)

    monkeypatch.setattr(neighbours, "_visit", counted)
    v = np.random.default_rng(6).normal(size=(600, 16))
    df = spark.createDataFrame([("x", i, row.tolist()) for i, row in enumerate(v)], "g string, i long, v array<double>")
    neighbours.nearest_in_group(df, df, "g", "i", "v", 5)
    (own, cells), (rows, pivots) = seen
    # without structure no cell can be closed, and there are the square root of 600 of them
    assert own == 600 and pivots < cells and rows <= 600 * pivots


@pytest.mark.parametrize("heads", [2, 64])
def test_top_ngrams_are_counted_of_able_words_only(spark, monkeypatch, heads):
    monkeypatch.setattr(corpus, "HEADS", heads)
    rng = np.random.default_rng(8)
    common = [["of", "the", "old", "house"][: rng.integers(2, 5)] for _ in range(60)]
    docs = [c + [f"w{i}a", f"w{i}b", f"w{i}c"] for i, c in enumerate(common)]
    langs = [["en", "de", None][i % 3] for i in range(60)]
    df = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(zip(langs, docs))], "id long, c string, t array<string>")
    counted, plain = [], corpus.ngram_counts

    def noted(*args, **named):
        out = plain(*args, **named)
        counted.append(out.count())
        return out

    monkeypatch.setattr(corpus, "ngram_counts", noted)
    got = {(r["c"], r["size"], r["rank"]): (r["ngram"], r["n"]) for r in corpus.top_ngrams_by_class(df, "id", "t", "c", [1, 2, 3], 2).collect()}
    want = {}
    for c in {*langs}:
        stream = [w for d, x in zip(docs, langs) if x == c for w in d]
        for n in (1, 2, 3):
            found = Counter(" ".join(stream[i : i + n]) for i in range(len(stream) - n + 1))
            for rank, (gram, m) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:2], 1):
                want[c, n, rank] = (gram, m)
    assert got == want
    if heads == 64:
        # after the single words and the first words' n-grams: of some 60 a class, those of common words only
        assert len(counted) == 5 and max(counted[2::2]) < 20


def test_heaviest_edges_are_counted_without_all_the_others(spark, monkeypatch):
    rng = np.random.default_rng(18)
    rows = [[None if w == 7 else f"w{w}" for w in rng.zipf(1.5, int(n)) if w < 400] for n in rng.integers(0, 60, 200)] + [None]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    want = {}
    for row in rows:
        for i, a in enumerate(row or []):
            for b in row[i + 1 : i + 3]:
                if a != b and a is not None and b is not None:
                    for edge in ((a, b), (b, a)):
                        want[edge] = want.get(edge, 0) + 1
    monkeypatch.setattr(corpus, "PAIRED", 500)
    every = corpus.cooccurrence(df, "t", 2)
    assert {(r["token"], r["context"]): r["n"] for r in every.collect()} == want
    heaviest = sorted(want.items(), key=lambda e: (-e[1], e[0]))[:20]
    few = corpus.cooccurrence(df, "t", 2, best=20)
    assert [((r["token"], r["context"]), r["n"]) for r in corpus.top_edges(few, 20).collect()] == heaviest
    assert few.count() < len(want) / 4
    # more than the edges of the most frequent words can bound, or than there are: all are counted
    monkeypatch.setattr(corpus, "HEADS", 2)
    assert corpus.cooccurrence(df, "t", 2, best=20).count() == len(want)
