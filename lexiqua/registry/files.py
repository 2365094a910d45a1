"""File round trips: every table written here derives from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import fresh_path
from ..sources import files, requests
from ..streaming import results as stream
from .base import documents, query, table


@query("csv_clean_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_clean_scan(spark, sf_dir):
    """Headers written with capitals, blanks and signs come back clean."""
    c = table(spark, sf_dir, "customer")
    messy = c.toDF("C Custkey ", "c_name", "C  NationKey", "C AcctBal (%)", " C MktSegment?")
    path = fresh_path(spark, "csv")
    files.write_csv(messy, path)
    return files.read_csv(spark, path, schema=c.schema, multi_line=False)


@query("csv_text_scan", "SELECT doc_id, lang, text FROM documents")
def csv_text_scan(spark, sf_dir):
    """Texts with quotes and line breaks survive the CSV round trip."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("Doc ID"), "lang", F.col("text").alias("TEXT"))
    path = fresh_path(spark, "csv")
    files.write_csv(d, path, escaped_breaks=True)
    back = files.read_csv(spark, path, multi_line=False, escaped_breaks=True)
    return back.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("recursive_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def recursive_scan(spark, sf_dir):
    return files.read_found(spark, sf_dir, "nation.parquet")


@query(
    "staged_roundtrip",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
)
def staged_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "orders")
    files.write_folder(table(spark, sf_dir, "orders"), path, partition_by=["o_orderstatus"])
    back = spark.read.parquet(path).where(F.col("o_orderstatus") == "F")
    return back.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("latest_snapshot", "SELECT c_custkey, c_acctbal, 10 AS checkpoint FROM customer")
def latest_snapshot(spark, sf_dir):
    """Snapshots 2 and 10: the numerically highest wins."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    path = fresh_path(spark, "snapshots")
    files.write_snapshot(c, path, 10)
    files.write_snapshot(c.withColumn("c_acctbal", F.lit(0.0)), path, 2)
    return files.read_latest_snapshot(spark, path)


@query("jsonl_sink", "SELECT event_id, event_type, value, props FROM events")
def jsonl_sink(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    path = fresh_path(spark, "events")
    files.write_json_lines(e, path)
    return spark.read.schema(e.schema).json(path)


# ---------------------------------------------------------------- model requests and results

REQUEST_SCHEMA = (
    "custom_id string, method string, url string, body struct<model: string, temperature: double, "
    "messages: array<struct<role: string, content: string>>, max_tokens: int>"
)


@query(
    "llm_batch_requests",
    """SELECT doc_id::VARCHAR AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'some-model' AS model, 0.2::DOUBLE AS temperature,
  'Name the language.' AS system, text AS user_prompt, 5 AS max_tokens FROM documents""",
)
def llm_batch_requests(spark, sf_dir):
    r = requests.batch_requests(documents(spark, sf_dir), "doc_id", "text", "some-model", 0.2, "Name the language.", 5)
    path = fresh_path(spark, "requests")
    files.write_json_lines(r, path)
    back = spark.read.schema(REQUEST_SCHEMA).json(path)
    return back.select(
        "custom_id",
        "method",
        "url",
        "body.model",
        "body.temperature",
        F.col("body.messages")[0]["content"].alias("system"),
        F.col("body.messages")[1]["content"].alias("user_prompt"),
        "body.max_tokens",
    )


def result_lines(spark, sf_dir, second: bool) -> DataFrame:
    """Lines of two result files for the documents.

    First file: every 17th line is cut off, every 19th has no choices, every 23rd a bad id.
    Second file: newer answers for ids ending in 3, and answers for ids no document has.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    answer = F.col("lang") if not second else F.concat(F.col("lang"), F.lit(" again"))
    row_id = F.col("doc_id").cast("string")
    if second:
        d = d.where(F.col("doc_id") % 10 == 3)
        row_id = F.when(F.col("doc_id") % 100 == 53, (F.col("doc_id") + 10**9).cast("string")).otherwise(row_id)
    else:
        row_id = F.when(F.col("doc_id") % 23 == 0, F.concat(F.lit("row "), row_id)).otherwise(row_id)
    choices = F.array(F.struct(F.struct(F.lit("assistant").alias("role"), answer.alias("content")).alias("message")))
    if not second:
        choices = F.when(F.col("doc_id") % 19 != 0, choices)
    body = F.struct(F.struct(choices.alias("choices")).alias("body"))
    line = F.to_json(F.struct(row_id.alias("custom_id"), body.alias("response")))
    if not second:
        line = F.when(F.col("doc_id") % 17 == 0, F.substr(line, F.lit(1), F.lit(25))).otherwise(line)
    return d.select(line.alias("value"))


_SQL_RESULTS = """one AS (SELECT doc_id AS id, lang AS content FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 23 <> 0),
two AS (SELECT CASE WHEN doc_id % 100 = 53 THEN doc_id + 1000000000 ELSE doc_id END AS id, lang || ' again' AS content FROM documents WHERE doc_id % 10 = 3),
latest AS (SELECT coalesce(two.id, one.id) AS id, coalesce(two.content, one.content) AS content FROM one FULL JOIN two ON one.id = two.id)"""


def _merged(spark, sf_dir):
    path = fresh_path(spark, "results")
    result_lines(spark, sf_dir, False).write.text(path)
    result_lines(spark, sf_dir, True).write.mode("append").text(path)
    d = table(spark, sf_dir, "documents").select("doc_id")
    return requests.merge_results(d, "doc_id", requests.read_results(spark, path), "answer")


@query(
    "llm_batch_merge",
    f"WITH {_SQL_RESULTS} SELECT doc_id, content AS answer FROM documents LEFT JOIN latest ON id = doc_id",
)
def llm_batch_merge(spark, sf_dir):
    return _merged(spark, sf_dir)[0]


@query(
    "llm_batch_rejects",
    f"""WITH {_SQL_RESULTS} SELECT NULL::BIGINT AS id, 'corrupt line' AS reason FROM documents WHERE doc_id % 17 = 0
UNION ALL SELECT NULL, 'bad id' FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 23 = 0
UNION ALL SELECT doc_id, 'no content' FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 23 <> 0 AND doc_id % 19 = 0
UNION ALL SELECT id, 'unknown id' FROM latest WHERE id NOT IN (SELECT doc_id FROM documents)""",
)
def llm_batch_rejects(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


@query("llm_results_stream", f"WITH {_SQL_RESULTS} SELECT id, content FROM latest")
def llm_results_stream(spark, sf_dir):
    """Two files arrive one after the other; the log is compacted in between."""
    source, log, place, snapshots = (fresh_path(spark, n) for n in ("arriving", "log", "stream", "snapshots"))
    result_lines(spark, sf_dir, False).write.text(source)
    stream.ingest(spark, source, log, place)
    stream.compact(spark, log, snapshots, upto=0)
    result_lines(spark, sf_dir, True).write.mode("append").text(source)
    stream.ingest(spark, source, log, place)
    return stream.current(spark, log, snapshots).select("id", "content")
