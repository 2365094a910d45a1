"""Registry of queries on the test tables and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.staging import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key`` with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def tokenized(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(doc_id, keep..., tokens) of every document."""
    return documents(spark, sf_dir).select("doc_id", *keep, X.tokens(F.col("text")).alias("tokens"))


def labelled(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Join the labels, one row per labelled document."""
    return df.join(table(spark, sf_dir, "labels"), "doc_id")


# ---------------------------------------------------------------- SQL building blocks

SQL_TOKENS = r"""
list_filter(string_split_regex(regexp_replace(lower(text),
  '([;@#$%&?!*,:()\[\]{}<>"]|\.+(?:\s|$))', ' \1 ', 'g'), '\s+'),
  lambda w: regexp_matches(w, '^\p{L}+$'))"""

# tok: one row per document; term: one row per token with its place
SQL_TOK = f"tok AS MATERIALIZED (SELECT doc_id, lang, {SQL_TOKENS} AS tokens FROM documents)"
SQL_TERM = f"""{SQL_TOK},
term AS MATERIALIZED (SELECT doc_id, lang, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM tok)"""


def sql_number(*parts: str) -> str:
    """SQL of the 60-bit number taken from the md5 of the parts."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def sql_key(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5({joined})"
