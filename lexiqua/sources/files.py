"""CSV with cleaned headers, recursive lookup, staged Parquet folders, snapshots, JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(name: str) -> str:
    """Lower snake case: already clean names stay, others lose all but letters, digits and spaces.

    A header cell that was empty (Spark calls it ``_cN``) becomes ``unnamed_N``.
    """
    if re.fullmatch(r"_c\d+", name):
        return f"unnamed_{name[2:]}"
    if re.match(r"^[a-z0-9_]+$", name):
        return name
    return re.sub(r"\s+", "_", re.sub(r"[^a-zA-Z0-9\s]", "", name.strip())).lower()


def _escaped(df: DataFrame) -> DataFrame:
    """Line breaks and backslashes of text columns as two-character escapes."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            text = F.col(f"`{f.name}`")
            for plain, coded in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
                text = F.replace(text, F.lit(plain), F.lit(coded))
            df = df.withColumn(f.name, text)
    return df


def _unescaped(df: DataFrame) -> DataFrame:
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            # parts between escaped backslashes; only in them do the other escapes count
            parts = F.split(F.col(f"`{f.name}`"), r"\\\\", -1)
            plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
            df = df.withColumn(f.name, F.array_join(plain, "\\"))
    return df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True, escaped_breaks: bool = False
) -> DataFrame:
    """CSV with a header row and doubled quotes; header names are cleaned.

    Quoted line breaks need ``multi_line``, which reads every file in one task.  Without it large
    files are split; ``escaped_breaks`` then undoes the escapes of ``write_csv``.  Without a
    schema every column is a string: inference would read the data twice.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", True)
    df = reader.csv(path)
    df = df.toDF(*[clean_name(c) for c in df.columns])
    return _unescaped(df) if escaped_breaks else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", escaped_breaks: bool = False) -> None:
    """CSV with a header row; ``escaped_breaks`` keeps every record on one line, so that files split."""
    writer = (_escaped(df) if escaped_breaks else df).write.mode(mode).option("header", True).option("escape", '"')
    # by default the writer would trim blanks at both ends of a text
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_found(spark: SparkSession, root: str, pattern: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """All files below ``root`` whose name matches ``pattern``, at any depth."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(root)


def write_folder(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """Preprocessed table as Parquet, partitioned so that later filters prune folders."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_snapshot(df: DataFrame, path: str, number: int) -> None:
    """Snapshot ``number`` of a table as ``checkpoint=<number>/``; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/checkpoint={number}")


def read_latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot with the numerically highest number, or None if there is none.

    The folder names carry the numbers, so only the chosen folder is scanned.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()]
    numbers = [int(m.group(1)) for m in (re.fullmatch(r"checkpoint=(\d+)", n) for n in names) if m]
    if not numbers:
        return None
    newest = max(numbers)
    return spark.read.parquet(f"{path.rstrip('/')}/checkpoint={newest}").withColumn("checkpoint", F.lit(newest))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line and row; NULL fields are kept."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.mode(mode).text(path)
