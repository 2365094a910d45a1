import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiqua.operators import corpus, sampling


@pytest.fixture(scope="module")
def rows(spark):
    c = F.when(F.col("id") == 0, "lone").when(F.col("id") % 10 < 7, "hot").otherwise("cold")
    return spark.range(1001).select("id", c.alias("c"))


@pytest.mark.parametrize("ratio", [0.0, 0.2, 1.0])
def test_stratified_sizes(rows, ratio):
    out = sampling.stratified_split(rows, "id", "c", ratio).toPandas()
    for _, part in out.groupby("c"):
        assert (part["split"] == "test").sum() == int(np.floor(len(part) * ratio))


def test_three_way_is_disjoint_and_complete(rows):
    out = sampling.three_way_split(rows, "id", "c").groupBy("split").count().collect()
    assert sum(r["count"] for r in out) == 1001 and {r["split"] for r in out} == {"test", "validation", "train"}


@pytest.mark.parametrize("ratio", [0.0, 0.3, 1.0])
def test_random_split_share(rows, ratio):
    share = sampling.random_split(rows, "id", ratio).where("split = 'test'").count() / 1001
    assert abs(share - ratio) < 0.05 and (ratio != 1.0 or share == 1.0)


def test_validation_is_not_in_the_rest(rows):
    validation, rest = sampling.validation_split(rows, "id", "c", 31)
    assert validation.join(rest, "id").count() == 0
    assert validation.count() + rest.count() == 1001
    # ten of each class, the lone row counts once
    assert validation.count() == 21


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_split_does_not_depend_on_partitions(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        test = sampling.stratified_split(rows.repartition(int(partitions)), "id", "c").where("split = 'test'")
        assert test.agg(F.sum(F.xxhash64("id") % 1000), F.count("id")).first() == (
            sampling.stratified_split(rows, "id", "c").where("split = 'test'").agg(F.sum(F.xxhash64("id") % 1000), F.count("id")).first()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_smote_points_lie_between_class_mates(spark):
    rng = np.random.default_rng(6)
    data = [(i, "big", rng.normal(size=3).tolist()) for i in range(60)]
    data += [(60 + i, "small", (rng.normal(size=3) + 9).tolist()) for i in range(10)] + [(70, "lone", [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(data, "id long, c string, v array<double>")
    out = sampling.smote_balanced(df, "id", "c", "v", k=3).toPandas()
    assert set(out.groupby("c").size()) == {60}
    assert (~out["is_synthetic"]).sum() == 71 and out[out["is_synthetic"]]["id"].isna().all()
    # without class mates a row is copied
    lone = out[(out["c"] == "lone") & out["is_synthetic"]]
    assert all(v == [1.0, 2.0, 3.0] for v in map(list, lone["v"]))
    members = np.array([d[2] for d in data if d[1] == "small"])
    for p in out[(out["c"] == "small") & out["is_synthetic"]]["v"]:
        p = np.array(p)
        detours = [
            np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a in members for b in members
        ]
        assert min(detours) < 1e-9


def test_balanced_classes_need_no_new_rows(spark):
    df = spark.createDataFrame([(1, "a", [0.0]), (2, "b", [1.0])], "id long, c string, v array<double>")
    assert sampling.smote_balanced(df, "id", "c", "v").where("is_synthetic").count() == 0


def test_augmentation_fills_every_deficit(spark):
    rows = [(i, "big", ["x", "y", "z"]) for i in range(9)] + [(9, "mid", ["p", "q"]), (10, "mid", ["q", "r"])] + [(11, "one", ["s"])]
    df = spark.createDataFrame(rows, "id long, c string, t array<string>")
    near = spark.createDataFrame([("p", "P"), ("q", "Q")], "token string, neighbour string")
    out = corpus.augment_minorities(df, "id", "t", "c", near, share=100).toPandas()
    assert out.groupby("c").size().to_dict() == {"mid": 7, "one": 8}
    assert set(out["text"]) <= {"P Q", "Q r", "s"}


def test_empty_copies_drop_out(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["x"]), (3, "b", [])], "id long, c string, t array<string>")
    near = spark.createDataFrame([], "token string, neighbour string")
    assert corpus.augment_minorities(df, "id", "t", "c", near).count() == 0


def test_stratified_sample_reads_total(rows, spark):
    assert sampling.stratified_sample(rows, "id", "c", 100).count() in range(97, 101)
    assert sampling.class_sample(rows, "id", "c", 5).count() == 11


def test_smote_of_one_member_and_a_large_deficit(spark):
    df = spark.range(301).select("id", F.when(F.col("id") == 300, "one").otherwise("many").alias("c"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    new = sampling.smote_balanced(df, "id", "c", "v").where("is_synthetic")
    assert new.count() == 299 and new.select("c", "v").distinct().collect() == [("one", [300.0, 1.0])]
