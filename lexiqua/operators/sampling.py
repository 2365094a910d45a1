"""Splits, samples and class balancing, all reproducible from md5 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_key, hash_number
from ..plans.joins import lookup_join, numbered_copies
from ..plans.neighbours import nearest_in_group
from ..plans.ordering import flag_by_hash, row_positions
from ..plans.staging import stage
from .profile import class_deficits

SEED = 12345


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_key", hash_key(F.lit(seed), F.col(id_col)))


def stratified_split(df: DataFrame, id_col: str, class_col: str, test_ratio: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``split`` = test for exactly floor(ratio * class size) rows of each class, else train."""
    flagged = flag_by_hash(_keyed(df, id_col, seed), [class_col], "_key", {"_test": lambda n: F.floor(n * test_ratio)})
    return flagged.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_key", "_test")


def random_split(df: DataFrame, id_col: str, test_ratio: float = 0.2, seed: int = SEED) -> DataFrame:
    """Unstratified split by comparing the key with a threshold: a narrow step, sizes only expected."""
    threshold = format(int(test_ratio * 16**8), "08x") if test_ratio < 1 else "g"
    key = hash_key(F.lit(seed), F.col(id_col))
    return df.withColumn("split", F.when(key < threshold, "test").otherwise("train"))


def three_way_split(
    df: DataFrame, id_col: str, class_col: str, test: float = 0.2, validation: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Adds ``split`` = test, validation or train with exact sizes in each class."""
    cuts = {
        "_test": lambda n: F.floor(n * test),
        "_held": lambda n: F.floor(n * test) + F.floor(n * validation),
    }
    flagged = flag_by_hash(_keyed(df, id_col, seed), [class_col], "_key", cuts)
    split = F.when(F.col("_test"), "test").when(F.col("_held"), "validation").otherwise("train")
    return flagged.withColumn("split", split).drop("_key", "_test", "_held")


def class_sample(df: DataFrame, id_col: str, class_col: str, per_class: int, seed: int = SEED) -> DataFrame:
    """``per_class`` hash-chosen rows of each class (all rows of a smaller class)."""
    flagged = flag_by_hash(_keyed(df, id_col, seed), [class_col], "_key", {"_in": lambda n: F.lit(per_class)})
    return flagged.where("_in").drop("_key", "_in")


def stratified_sample(df: DataFrame, id_col: str, class_col: str, total: int, seed: int = SEED) -> DataFrame:
    """About ``total`` rows, each class with floor(its share) of them."""
    rows = df.count()
    share = {"_in": lambda n: F.floor(n * F.lit(total) / F.lit(max(rows, 1)))}
    return flag_by_hash(_keyed(df, id_col, seed), [class_col], "_key", share).where("_in").drop("_key", "_in")


def validation_split(df: DataFrame, id_col: str, class_col: str, sample_size: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(validation, rest): ``sample_size // classes`` rows per class are set aside.  The rest is the
    complement of the same flag, so no sampled row can stay in it and no anti join is needed."""
    per_class = sample_size // df.agg(F.countDistinct(class_col).alias("n")).first()["n"]
    flagged = flag_by_hash(_keyed(df, id_col, seed), [class_col], "_key", {"_in": lambda n: F.lit(per_class)}).drop("_key")
    return flagged.where("_in").drop("_in"), flagged.where(~F.col("_in")).drop("_in")


def sample_flags(df: DataFrame, sample: DataFrame, id_col: str, flag: str = "ft") -> DataFrame:
    """Left join of a sample on the row id: true for sampled rows, false for all others."""
    marks = sample.select(id_col, F.lit(True).alias(flag))
    return df.join(marks, id_col, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def smote_balanced(
    df: DataFrame, id_col: str, class_col: str, vector_col: str, k: int = 5, seed: int = SEED, flag: str = "is_synthetic"
) -> DataFrame:
    """Originals plus synthetic rows that lift every class to the largest (Chawla et al. 2002).

    Every missing row takes a hash-chosen member of its class, one of that member's k nearest class
    mates and a hash-chosen point between them.  A class without neighbours gets copies.
    Columns: id (NULL for new rows), class, vector, flag.
    """
    members = stage(
        df.select(F.col(class_col).alias("_class"), F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")),
        "members",
    )
    # only ids are put in order; vectors join when the seeds are known
    places = stage(row_positions(members.select("_class", "_id"), ["_class"], [F.col("_id").asc()], "_pos"), "places")
    copies = numbered_copies(stage(class_deficits(members, "_class"), "deficits"), "deficit", "_copy")
    picks = copies.select(
        "_class",
        "_copy",
        F.pmod(hash_number(F.lit(seed), F.lit("row"), F.col("_class"), F.col("_copy")), F.col("n")).alias("_pos"),
        hash_number(F.lit(seed), F.lit("mate"), F.col("_class"), F.col("_copy")).alias("_mate"),
        (hash_number(F.lit(seed), F.lit("gap"), F.col("_class"), F.col("_copy")) / F.lit(float(16**15))).alias("_gap"),
    )
    # a small class with a large deficit draws the same members again and again: copies salt the joins
    drawn = stage(lookup_join(picks, places, ["_class", "_pos"], salt_by=["_copy"]).drop("_pos"), "drawn")
    seeds = members.join(drawn.select("_id").distinct(), "_id", "left_semi")
    near = nearest_in_group(members, seeds, "_class", "_id", "_v", k)
    lists = near.groupBy("_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour_id").alias("id")))).alias("_near")
    )
    mate = F.when(
        F.size("_near") > 0, F.get(F.col("_near.id"), F.pmod(F.col("_mate"), F.size("_near")).cast("int"))
    ).otherwise(F.col("_id"))
    vectors = members.select("_id", "_v")
    mated = lookup_join(drawn, stage(lists, "lists"), ["_id"], salt_by=["_copy"], how="left")
    mated = mated.select("_class", "_copy", "_id", "_gap", mate.alias("_mate_id"))
    seeded = lookup_join(mated, vectors, ["_id"], salt_by=["_copy"])
    mixed = lookup_join(seeded, vectors.toDF("_mate_id", "_w"), ["_mate_id"], salt_by=["_copy"])
    point = F.zip_with("_v", "_w", lambda x, y: x + (y - x) * F.col("_gap"))
    new = mixed.select(
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col),
        F.col("_class").alias(class_col),
        point.alias(vector_col),
        F.lit(True).alias(flag),
    )
    old = df.select(id_col, class_col, F.col(vector_col).cast("array<double>").alias(vector_col), F.lit(False).alias(flag))
    return old.unionByName(new)
