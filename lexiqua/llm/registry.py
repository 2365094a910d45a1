"""One query per operator on the test tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, decontam, lines, neardup, periodic, pii, prefixtree, quality, secrets, shards, warc
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.read_back(chat.conversations(turns)))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_periods(table(spark, sf_dir, "documents"))))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.jaccard_components(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat, op2_secrets, op3_pii, op4_decontaminate, op5_quality, op6_bpe, op7_shards, op8_lines, op9_near_duplicates, op10_warc,
        op11_periodic_runs, op12_ngram_join, op13_collocations,
    )
}
ORACLES: dict[str, str] = {
    "op1_chat": chat.SQL,
    "op4_decontaminate": decontam.SQL,
    "op8_lines": lines.SQL,
    "op9_near_duplicates": neardup.SQL,
    "op10_warc": warc.SQL,
    "op11_periodic_runs": periodic.SQL,
    "op12_ngram_join": prefixtree.SQL,
    "op13_collocations": collocations.SQL,
}
