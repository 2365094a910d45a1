"""Feature columns: multi-hot, entity counts, vector columns, scaling, term scores, annotators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import LANGUAGE_NAMES
from ..plans.joins import class_values, token_lookup


def multi_hot(df: DataFrame, list_col: str, prefix: str, values: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """One 0/1 column per distinct list value, in value order; NULLs and empty lists give zeros.

    The values become columns, so their number is checked; pass them to skip the extra pass.
    """
    if values is None:
        values = class_values(df.select(F.explode(list_col).alias("v")), "v", limit)
    has = [
        F.coalesce(F.array_contains(list_col, v), F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in values
    ]
    return df.select(*[c for c in df.columns if c != list_col], *has)


def multi_hot_long(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """The ones of a multi-hot table as (id, value) rows, for any number of values; NULLs count as none."""
    return df.select(id_col, F.explode(F.array_distinct(F.array_compact(list_col))).alias("value"))


def entity_counts(df: DataFrame, entities_col: str, types: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """Count of entities per type as ``entity_<TYPE>`` columns."""
    if types is None:
        types = class_values(df.select(F.explode(F.col(f"{entities_col}.type")).alias("v")), "v", limit)

    def count(kind: str) -> Column:
        found = F.filter(F.col(f"{entities_col}.type"), lambda t: t == kind)
        return F.coalesce(F.size(found), F.lit(0)).alias(f"entity_{kind}")

    counts = [count(t) for t in types]
    return df.select(*[c for c in df.columns if c != entities_col], *counts)


def embedding_columns(df: DataFrame, vector_col: str, size: int | None = None) -> DataFrame:
    """Spread a vector into ``col_embedding_1..n``."""
    if size is None:
        size = df.agg(F.max(F.size(vector_col))).first()[0] or 0
    spread = [F.get(vector_col, F.lit(i)).alias(f"col_embedding_{i + 1}") for i in range(size)]
    return df.select(*[c for c in df.columns if c != vector_col], *spread)


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns centred and divided by the population deviation; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    scaled = {}
    for c in columns:
        mean, dev = stats[f"m_{c}"], stats[f"s_{c}"]
        value = (F.col(c) - F.lit(mean)) / F.lit(dev) if dev else F.col(c) * 0.0
        scaled[c] = value
    return df.withColumns(scaled)


def binarized(df: DataFrame, label_col: str, classes: list) -> DataFrame:
    """One row per (row, class) with a 0/1 ``is_class`` column."""
    return df.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes]))).withColumn(
        "is_class", (F.col(label_col) == F.col("class")).cast("int")
    )


def average_term_score(df: DataFrame, id_col: str, tokens_col: str, scores: DataFrame) -> DataFrame:
    """Mean score of the tokens found in ``scores(term, score)``; repeats count, none gives NULL."""
    hits = token_lookup(df, [id_col], tokens_col, scores.select("term", "score"), salt_by=[id_col])
    means = hits.groupBy(id_col).agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("avg_score"))
    return df.select(id_col).join(means, id_col, "left")


def language_names(df: DataFrame, lang_col: str, name_col: str = "language_name") -> DataFrame:
    """Add the language's name; an unknown code reads 'unknown'."""
    rows = list(LANGUAGE_NAMES.items())
    names = df.sparkSession.createDataFrame(rows, f"{lang_col} string, {name_col} string")
    joined = df.join(F.broadcast(names), lang_col, "left")
    return joined.withColumn(name_col, F.coalesce(name_col, F.lit(LANGUAGE_NAMES["xxx"])))


def importance_rollup(importance: DataFrame, originals: list[str], method: str = "sum") -> DataFrame:
    """Importance of encoded features added up (or averaged) per original column.

    An encoded feature belongs to every original whose name it contains.  The originals are the
    columns of a table, so each is one conditional aggregate and nothing has to be joined.
    """
    parts: list[Column] = []
    for original in originals:
        mine = F.when(F.col("feature").contains(original), F.col("importance"))
        value = F.avg(mine) if method == "average" else F.coalesce(F.sum(mine), F.lit(0.0))
        parts.append(F.struct(F.lit(original).alias("feature"), value.alias("importance")))
    rolled = importance.groupBy("model").agg(F.array(*parts).alias("parts"))
    return rolled.select("model", F.inline("parts"))


def annotate(
    df: DataFrame,
    loader: Callable[[str], Callable[[pd.Series], pd.Series] | None],
    text_col: str,
    lang_col: str,
    out_col: str,
    out_type: str,
) -> DataFrame:
    """Apply a per-language annotator to Arrow batches.

    ``loader(lang)`` is called once per language and Python worker and returns a function from a
    text series to a series of lists, or None for an unsupported language (empty list).
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict = {}
        for batch in batches:
            out = pd.Series([[] for _ in range(len(batch))], index=batch.index, dtype="object")
            for lang, rows in batch.groupby(lang_col).groups.items():
                if lang not in models:
                    models[lang] = loader(lang)
                if models[lang] is not None:
                    values = models[lang](batch.loc[rows, text_col])
                    for i, v in zip(rows, values):
                        out.at[i] = v
            yield batch.assign(**{out_col: out})

    return df.mapInPandas(run, f"{schema}, `{out_col}` {out_type}")


def score_batches(
    df: DataFrame,
    loader: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    out_col: str,
    out_type: str = "array<double>",
) -> DataFrame:
    """Apply an external scorer to Arrow batches; ``loader`` runs once per Python worker task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = loader()
        for batch in batches:
            yield batch.assign(**{out_col: score(batch)})

    return df.mapInPandas(run, f"{schema}, `{out_col}` {out_type}")
