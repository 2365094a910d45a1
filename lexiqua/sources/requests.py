"""JSON-lines exchange with external chat models: request files, result files, tuning files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Request method and path of a chat completion batch.
METHOD = "POST"
ENDPOINT = "/v1/chat/completions"

RESULT_SCHEMA = (
    "custom_id string, "
    "response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>, "
    "_corrupt_record string"
)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def batch_requests(
    df: DataFrame, id_col: str, prompt_col: str, model: str, temperature: float, system_prompt: str, max_tokens: int
) -> DataFrame:
    """One request per row: custom_id, method, url, body{model, temperature, messages, max_tokens}."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.lit(temperature).alias("temperature"),
        F.array(_message("system", F.lit(system_prompt)), _message("user", F.col(prompt_col))).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
    )
    return df.select(
        F.col(id_col).cast("string").alias("custom_id"), F.lit(METHOD).alias("method"), F.lit(ENDPOINT).alias("url"), body.alias("body")
    )


def tuning_messages(df: DataFrame, prompt_col: str, target_col: str, system_prompt: str, keep: list[str] = ()) -> DataFrame:
    """``messages`` [system, user, assistant] per row."""
    messages = F.array(
        _message("system", F.lit(system_prompt)),
        _message("user", F.col(prompt_col).cast("string")),
        _message("assistant", F.col(target_col).cast("string")),
    )
    return df.select(*keep, messages.alias("messages"))


def parse_results(lines: DataFrame) -> DataFrame:
    """Result rows (id, content, seq, reason, line) from a JSON reader with ``RESULT_SCHEMA``.

    ``seq`` orders lines by file time, file name and place in the file, so later lines win.
    """
    content = F.col("response.body.choices")[0]["message"]["content"]
    row_id = F.expr("try_cast(custom_id as bigint)")
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "corrupt line")
        .when(row_id.isNull(), "bad id")
        .when(content.isNull(), "no content")
    )
    return lines.select(row_id.alias("id"), content.alias("content"), "seq", reason.alias("reason"), F.col("_corrupt_record").alias("line"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").json(path)
    seq = F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return parse_results(lines.select("*", seq.alias("seq")))


def latest_results(results: DataFrame) -> DataFrame:
    """One row per id: the content of its last good line."""
    good = results.where(F.col("reason").isNull())
    return good.groupBy("id").agg(F.max_by("content", "seq").alias("content"))


def merge_results(df: DataFrame, id_col: str, results: DataFrame, target_col: str) -> tuple[DataFrame, DataFrame]:
    """(table with ``target_col`` filled by id, rejects).  Rejects are unreadable lines and ids that the
    table does not hold; unlike a positional write-back, an unknown id adds no row."""
    latest = latest_results(results)
    answers = latest.select(F.col("id").alias("_result_id"), F.col("content").alias(target_col))
    merged = df.join(answers, F.col(id_col) == F.col("_result_id"), "left").drop("_result_id")
    known = df.select(F.col(id_col).cast("long").alias("id"))
    unmatched = latest.join(known, "id", "left_anti").select("id", F.lit("unknown id").alias("reason"))
    bad = results.where(F.col("reason").isNotNull()).select("id", "reason")
    return merged, bad.unionByName(unmatched)
