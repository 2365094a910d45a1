"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words are what stands between these characters: \x20 and \x09-\x0D, which bytes.split() uses too.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: Texts are taken from an Arrow batch in slices of about so many characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) + 1
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame, keep: list[str], text: str, schema: T.StructType, make: Callable[[], Callable[[list[str]], dict]]
) -> DataFrame:
    """One row per row of ``df``: its ``keep`` columns and what ``make()`` returns for its text.

    ``make`` is called once per task and gives a function from a list of texts (null: empty) to
    columns, so that models load once and memory stays within a slice of the batch.
    """
    kept = T.StructType([df.schema[c] for c in keep])
    out = T.StructType(kept.fields + schema.fields)
    arrow, names = to_arrow_schema(schema), [f.name for f in schema.fields]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(n_keep).to_pylist()]
            for a, b in slices(texts):
                made = apply(texts[a:b])
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(n_keep)]
                columns += [pa.array(made[n], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return df.select(*keep, text).mapInArrow(run, out)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
