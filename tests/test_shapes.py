"""Physical plans: what must not appear in them, and what must."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lexiqua.plans.ordering import flag_by_hash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROW_LEVEL = [
    "tokens", "pii_masked", "cttr", "shape_tags", "entities", "embedding_columns", "multi_hot", "random_split",
    "stratified_split", "three_way_split", "validation_split", "iqr_filtered", "standard_scaled", "label_binarized",
]


@pytest.mark.parametrize("key", ROW_LEVEL)
def test_rows_never_meet_in_one_partition(spark, small, key):
    p = plan(queries()[key](spark, small))
    assert "SinglePartition" not in p and "CartesianProduct" not in p and "Python" not in p


@pytest.mark.parametrize("key", ["tokens", "cttr", "pii_masked", "random_split", "multi_hot", "entity_counts"])
def test_narrow_queries_only_spread_the_scan(spark, small, key):
    p = plan(queries()[key](spark, small))
    assert p.count("Exchange") <= 1 and "hashpartitioning" not in p


@pytest.mark.parametrize("key", ["top_tokens_by_class", "top_entities", "top_ngrams_by_class", "tfidf_by_class"])
def test_top_k_is_limited_before_the_shuffle(spark, small, key):
    assert re.search(r"WindowGroupLimit .*Partial", plan(queries()[key](spark, small)))


def test_filters_and_columns_reach_the_scan(spark, small):
    p = plan(queries()["supported_languages"](spark, small))
    assert "PushedFilters: [In(lang" in p and "ReadSchema: struct<lang:string>" in p
    p = plan(queries()["values_by_class"](spark, small))
    assert "text" not in re.search(r"ReadSchema: (\S+)", p).group(1)


def test_partition_pruning(spark, small):
    p = plan(queries()["staged_roundtrip"](spark, small))
    assert re.search(r"PartitionFilters: \[.*o_orderstatus", p)


def test_tfidf_places_rows_by_id_once(spark, small):
    p = plan(queries()["tfidf_overall"](spark, small))
    assert p.count("hashpartitioning(doc_id") == 1


def test_split_scans_the_rows_without_shuffling_them(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("c"), F.md5(F.col("id").cast("string")).alias("k"))
    p = plan(flag_by_hash(df, ["c"], "k", {"t": lambda n: F.floor(n / 5)}))
    top = p.split("BroadcastHashJoin")[1]
    assert "BroadcastExchange" in top


def test_no_forbidden_calls():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "lexiqua"
    source = "\n".join(f.read_text() for f in root.rglob("*.py"))
    assert "localCheckpoint(" not in source and "crossJoin(" not in source
