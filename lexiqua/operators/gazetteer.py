"""Names of a gazetteer in token lists: the longest match at each place, from left to right.

The gazetteer is a trie kept as a table, one row per node: the depth and the tokens that lead to it.
Texts walk it level by level.  Every level is a join that only keeps the places whose tokens so far
are the beginning of a name, so most places go with the first one, and a text never meets the names
as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.staging import stage

_SEPARATOR = "\u001f"


def name_trie(names: DataFrame, tokens_col: str, type_col: str) -> DataFrame:
    """(depth, path, type): the nodes of all names; ``type`` is set where a name ends.

    Names are token lists; null and empty ones are left out, and of several types of one name the
    first in order stays.
    """
    tokens = F.col(tokens_col)
    each = names.where(F.size(tokens) > 0).select(tokens.alias("t"), F.col(type_col).alias("type"))
    nodes = each.select("t", "type", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("depth"))
    ends = F.when(F.col("depth") == F.size("t"), F.col("type"))
    path = F.array_join(F.slice("t", F.lit(1), F.col("depth")), _SEPARATOR)
    return nodes.select("depth", path.alias("path"), ends.alias("type")).groupBy("depth", "path").agg(F.min("type").alias("type"))


def _leftmost(found: Column) -> Column:
    """From (start, -length, ...) structs in order those that begin behind the end of the one before."""
    empty = F.filter(found, lambda m: F.lit(False))
    start = F.struct(F.lit(0).cast("int").alias("end"), empty.alias("kept"))

    def step(state: Column, m: Column) -> Column:
        fits = m["start"] >= state["end"]
        return F.struct(
            F.when(fits, m["start"] - m["negative"]).otherwise(state["end"]).alias("end"),
            F.when(fits, F.concat(state["kept"], F.array(m))).otherwise(state["kept"]).alias("kept"),
        )

    return F.aggregate(found, start, step, lambda s: s["kept"])


def gazetteer_entities(df: DataFrame, id_col: str, tokens_col: str, names: DataFrame, name_tokens: str = "tokens", type_col: str = "type") -> DataFrame:
    """(id, start, length, entity, type): names in each row's tokens, longest leftmost, none overlapping.

    ``start`` counts tokens from 0, ``entity`` joins them by blanks.  Ids are unique; rows without
    tokens give nothing.
    """
    trie = stage(name_trie(names, name_tokens, type_col), "trie")
    depth = trie.agg(F.max("depth").alias("d")).first()["d"] or 0
    tokens = F.col(tokens_col)
    windows = F.transform(tokens, lambda t, i: F.struct(i.alias("start"), F.slice(tokens, i + 1, max(depth, 1)).alias("window")))
    at = df.select(F.col(id_col).alias("id"), F.inline(windows))
    found = None
    for level in range(1, depth + 1):
        nodes = trie.where(F.col("depth") == level).select("path", "type")
        reach = at.where(F.size("window") >= level).withColumn("path", F.array_join(F.slice("window", 1, level), _SEPARATOR))
        at = stage(lookup_join(reach, nodes, ["path"], ["id", "start"]), "places")
        ends = at.where("type IS NOT NULL").select("id", "start", F.lit(-level).alias("negative"), F.slice("window", 1, level).alias("words"), "type")
        found = ends if found is None else found.unionByName(ends)
        at = at.drop("path", "type")
    if found is None:
        return df.select(F.col(id_col), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("entity"), F.lit("").alias("type")).limit(0)
    lists = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "negative", "words", "type"))).alias("m"))
    kept = lists.select("id", F.inline(_leftmost(F.col("m"))))
    return kept.select(F.col("id").alias(id_col), "start", (-F.col("negative")).alias("length"), F.array_join("words", " ").alias("entity"), "type")
