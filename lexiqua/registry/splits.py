"""Splits, samples and class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from ..plans.staging import fresh_path, spread
from ..sources.files import write_json_lines
from ..sources.requests import tuning_messages
from .base import documents, query, sql_key, sql_number, table
from .tables import SQL_NEAR

_RANKED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_key('12345', 'o_orderkey')}) AS r,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)"""


@query(
    "stratified_split",
    f"WITH {_RANKED} SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r",
)
def stratified_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_split(o, "o_orderkey", "o_orderstatus", 0.2)


@query(
    "random_split",
    f"SELECT o_orderkey, CASE WHEN {sql_key('12345', 'o_orderkey')} < '33333333' THEN 'test' ELSE 'train' END AS split FROM orders",
)
def random_split(spark, sf_dir):
    return sampling.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query(
    "three_way_split",
    f"""WITH {_RANKED} SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test'
  WHEN r <= floor(n * 0.2::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def three_way_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.three_way_split(o, "o_orderkey", "o_orderstatus", 0.2, 0.2)


@query(
    "validation_split",
    f"WITH {_RANKED} SELECT o_orderkey, o_orderstatus, CASE WHEN r <= 1000 // 3 THEN 'validation' ELSE 'train_test' END AS part FROM r",
)
def validation_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    validation, rest = sampling.validation_split(o, "o_orderkey", "o_orderstatus", 1000)
    return validation.withColumn("part", F.lit("validation")).unionByName(rest.withColumn("part", F.lit("train_test")))


@query(
    "sample_flag_join",
    f"WITH {_RANKED} SELECT o_orderkey, o_orderstatus, r <= 50 AS ft FROM r",
)
def sample_flag_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.sample_flags(o, sampling.class_sample(o, "o_orderkey", "o_orderstatus", 50), "o_orderkey")


SYSTEM_PROMPT = "Name the language of the text."


@query(
    "finetune_export",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {sql_key('12345', 'doc_id')}) AS r,
  count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents)
SELECT 'total' AS mode, doc_id, '{SYSTEM_PROMPT}' AS system, text AS user_prompt, lang AS answer FROM r WHERE r <= floor(n * 100 / total)
UNION ALL SELECT 'per_class', doc_id, '{SYSTEM_PROMPT}', text, lang FROM r WHERE r <= 25""",
)
def finetune_export(spark, sf_dir):
    """Both readings of the sample size, written as JSON lines and read back."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang")
    samples = sampling.stratified_sample(d, "doc_id", "lang", 100).withColumn("mode", F.lit("total")).unionByName(
        sampling.class_sample(d, "doc_id", "lang", 25).withColumn("mode", F.lit("per_class"))
    )
    m = tuning_messages(samples, "text", "lang", SYSTEM_PROMPT, keep=["mode", "doc_id"])
    path = fresh_path(spark, "tuning")
    write_json_lines(m, path)
    m = spark.read.schema(m.schema).json(path)
    contents = [F.col("messages")[i]["content"].alias(n) for i, n in enumerate(("system", "user_prompt", "answer"))]
    return m.select("mode", "doc_id", *contents)


def _pick(kind: str) -> str:
    return sql_number("12345", f"'{kind}'", "c.label", "copy")


@query(
    "smote_balanced",
    f"""WITH {SQL_NEAR}, size AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS deficit FROM embeddings GROUP BY label),
m AS (SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM v),
c AS (SELECT label, n, unnest(range(deficit)) AS copy FROM size),
p AS (SELECT c.label, copy, m.vec_id, m.v, {_pick('mate')} AS mate, {_pick('gap')} / pow(16::DOUBLE, 15) AS gap
  FROM c JOIN m ON m.label = c.label AND m.pos = {_pick('row')} % n),
l AS (SELECT vec_id, list(neighbour_id ORDER BY rank) AS near FROM near GROUP BY vec_id),
s AS (SELECT p.label, p.v AS x, w.v AS y, gap FROM p JOIN l USING (vec_id) JOIN v w ON w.vec_id = near[(mate % len(near)) + 1]),
b AS (SELECT vec_id, label, false AS is_synthetic, v AS p FROM v
  UNION ALL SELECT NULL, label, true, list_transform(range(1, 65), lambda i: x[i] + (y[i] - x[i]) * gap) FROM s)
SELECT vec_id, label, is_synthetic, unnest(range(len(p))) AS dimension, round(unnest(p), 6) AS value FROM b""",
)
def smote_balanced(spark, sf_dir):
    e = spread(table(spark, sf_dir, "embeddings"))
    b = sampling.smote_balanced(e, "vec_id", "label", "embedding")
    each = b.select("vec_id", "label", "is_synthetic", F.posexplode("embedding").alias("dimension", "value"))
    return each.withColumn("dimension", F.col("dimension").cast("long")).withColumn("value", F.round("value", 6))
