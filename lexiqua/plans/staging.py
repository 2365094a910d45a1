"""Staged tables: intermediate results written once to the shared checkpoint folder.

An intermediate that several branches of a plan read is written as Parquet and read
back.  That cuts the lineage, keeps column pruning, and survives lost executors, which a
cached block or a local checkpoint does not.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: How the path of a folder on a machine's own disk begins.
LOCAL = r"file:|/"


def staging_root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``, or, where that is unset, below
    the warehouse.  A warehouse on a machine's own disk is refused on a cluster, as executors would
    not find each other's files there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
        if re.match(LOCAL, root):
            check_shared(root, spark.sparkContext.master)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def check_shared(root: str, master: str) -> None:
    """Raise if ``root`` is local to a machine and ``master`` is a cluster's."""
    if not master.startswith("local") and re.match(LOCAL, root):
        raise ValueError(f"{root} is a folder of one machine; set spark.checkpoint.dir to one that all executors share")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nothing has been written to yet."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting that drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions in this block leave no shuffle files behind; otherwise these stay on disk until
    the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` once and return the table that reads it back.  Rows of a value of ``by``, of which
    there are few, are kept apart, so that reading one value passes over the others."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, neither directly nor in a plan that is still
    to run.  What this application has not staged stays."""
    for table in staged:
        spark = table.sparkSession
        own = re.compile(rf".*/{re.escape(spark.sparkContext.applicationId)}/[^/]+-[0-9a-f]{{12}}(?=/)")
        for folder in {found.group() for f in table.inputFiles() if (found := own.match(f))}:
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete everything this application staged (call when its results are consumed)."""
    _delete(spark, staging_root(spark))


def spread(df: DataFrame) -> DataFrame:
    """Repartition only if the scan yields fewer tasks than the cluster has cores.

    Large tables have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
