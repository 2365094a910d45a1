"""Result files that arrive over time, merged into a table exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_latest_snapshot, write_snapshot
from ..sources.requests import RESULT_SCHEMA, parse_results

LOG_SCHEMA = (
    "id bigint, content string, seq struct<time: timestamp, file: string, block: bigint, line: bigint>, "
    "reason string, line string, batch bigint"
)


def ingest(spark: SparkSession, source: str, log: str, checkpoint: str) -> None:
    """Read every file of ``source`` not read before and append its rows to ``log``.

    A micro batch owns the folder ``batch=<n>`` and overwrites it when it is retried, so together
    with the file checkpoint each line lands once.  The cost is that of the new files, not of the
    table.
    """
    lines = spark.readStream.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").json(source)
    seq = F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("seq", F.col("seq").withField("line", F.monotonically_increasing_id()))
        parse_results(numbered).write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = (
        lines.select("*", seq.alias("seq"))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(log)


def compact(spark: SparkSession, log: str, snapshots: str, upto: int) -> None:
    """Fold the log through batch ``upto`` and the former snapshot into snapshot ``upto``."""
    write_snapshot(current(spark, log, snapshots, upto), snapshots, upto)


def current(spark: SparkSession, log: str, snapshots: str | None = None, upto: int | None = None) -> DataFrame:
    """(id, content, seq): the last good line of every id, from the newest snapshot and later batches.

    The snapshot number is a partition bound, so compacted batches are pruned from the scan.
    """
    rows = read_log(spark, log).where(F.col("reason").isNull())
    base = read_latest_snapshot(spark, snapshots) if snapshots else None
    if base is not None:
        rows = rows.where(F.col("batch") > base.select("checkpoint").first()[0])
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    rows = rows.select("id", "content", "seq")
    if base is not None:
        rows = rows.unionByName(base.select("id", "content", "seq"))
    last = F.max_by(F.struct("content", "seq"), "seq")
    return rows.groupBy("id").agg(last.alias("_l")).select("id", "_l.content", "_l.seq")
