"""What staged tables leave on disk."""

import os
import time

from pyspark.sql import functions as F

from lexiqua.operators import corpus
from lexiqua.plans.staging import CLEANUP, discard, stage, staging_root


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def staged(spark):
    root = staging_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.exists(root) else set()


def test_staging_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    kept = stage(spark.range(50_000).groupBy((F.col("id") % 977).alias("k")).count())
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kept.count() == 977 and spark.conf.get(CLEANUP) == setting


def test_discard_deletes_staged_tables_only(spark, small, tmp_path):
    before = staged(spark)
    spark.range(3).write.parquet(f"{tmp_path}/own")
    own, whole, parts = spark.read.parquet(f"{tmp_path}/own"), stage(spark.range(10), "whole"), stage(spark.range(10).withColumn("g", F.col("id") % 3), "parts", by="g")
    assert parts.where("g = 1").count() == 3 and len(staged(spark) - before) == 2
    discard(own, whole.where("id > 1"), parts)
    assert staged(spark) == before and own.count() == 3


def test_augmentation_leaves_little_on_disk(spark):
    """Neither the words in their places nor their contexts and candidates stay, nor a copy of the rows."""
    rows = [(i, "a", ["x", "y", "z", "x", "w"][: 2 + i % 4]) for i in range(12)] + [(100 + i, "b", ["y", "z", "x"]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, c string, t array<string>")
    near = spark.createDataFrame([("x", "y"), ("x", "z"), ("y", "x"), ("z", "w")], "token string, neighbour string")
    before = staged(spark)
    out = corpus.augment_in_context(df, "id", "t", "c", near, share=100)
    left = {n.rpartition("-")[0] for n in staged(spark) - before}
    assert not left & {"rows", "words", "contexts", "seen", "fitted", "factors", "bigrams", "near", "used"}
    assert out.count() == 9
