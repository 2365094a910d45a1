"""Corpus statistics: n-grams, collocations, co-occurrence, TF-IDF, vocabulary, language profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import argmax, hash_number, hash_numbers
from ..plans.joins import class_values, fits_broadcast, key_counts, lookup_join, numbered_copies, small_side, token_lookup, top_k
from ..plans.ordering import row_positions
from ..plans.staging import discard, stage
from .profile import class_deficits

HALO_BLOCK = 10_000


def _zipped(words: Column, n: int) -> Column:
    """Array of structs (w1..wn) of adjacent tokens, from n shifted slices of the same list."""
    count = F.greatest(F.size(words) - n + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(words, i + 1, count).alias(f"w{i + 1}") for i in range(n)])


def term_counts(df: DataFrame, tokens_col: str, term: str = "term", n: str = "n") -> DataFrame:
    return df.select(F.explode(tokens_col).alias(term)).groupBy(term).agg(F.count(F.lit(1)).alias(n))


def document_terms(df: DataFrame, keys: list[str], tokens_col: str) -> DataFrame:
    """(keys, term, tf): the long bag-of-words table; repeats combine before any shuffle."""
    exploded = df.select(*keys, F.explode(tokens_col).alias("term"))
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


# ---------------------------------------------------------------- n-grams

def border_ngrams(df: DataFrame, id_col: str, tokens_col: str, n: int, group: list[str]) -> DataFrame:
    """n-grams that start in one row and end in a later one (rows in id order inside ``group``).

    Only the first and last n-1 tokens of each row travel.  Rows get global positions and are cut
    into blocks; the first n-1 rows of a block are copied to the block before it (a halo), so
    every window stays inside one block of bounded size.
    """
    edge = n - 1
    words = F.col(tokens_col)
    edges = df.where(F.size(words) > 0).select(
        *group,
        id_col,
        F.slice(words, 1, edge).alias("_head"),
        F.slice(words, F.greatest(F.size(words) - edge + 1, F.lit(1)), edge).alias("_tail"),
    )
    placed = row_positions(edges, group, [F.col(id_col).asc()], "_pos")
    block = F.floor(F.col("_pos") / HALO_BLOCK)
    halo = (F.col("_pos") % HALO_BLOCK < edge) & (block > 0)
    blocks = placed.withColumn(
        "_block", F.explode(F.when(halo, F.array(block, block - 1)).otherwise(F.array(block)))
    ).withColumn("_own", F.col("_block") == block)
    ahead = Window.partitionBy(*group, "_block").orderBy("_pos").rowsBetween(1, edge)
    stream = F.concat("_tail", F.slice(F.flatten(F.collect_list("_head").over(ahead)), 1, edge))
    streams = blocks.select(*group, "_own", stream.alias("_stream")).where("_own")
    return streams.select(*group, F.inline(_zipped(F.col("_stream"), n)))


def ngram_counts(
    df: DataFrame, id_col: str, tokens_col: str, n: int, group: list[str] = (), scope: str = "corpus", words: DataFrame | None = None
) -> DataFrame:
    """(group, w1..wn, n).  ``corpus`` joins all rows of a group into one token stream, so n-grams
    also cross row borders; ``document`` keeps them inside rows.  With ``words`` (group, w1), a small
    table, only n-grams made of these are counted."""
    group = list(group)
    inner = df.select(*group, F.inline(_zipped(F.col(tokens_col), n)))
    if scope == "corpus" and n > 1:
        inner = inner.unionByName(border_ngrams(df, id_col, tokens_col, n, group))
    elif scope not in ("corpus", "document"):
        raise ValueError("scope must be 'corpus' or 'document'")
    for i in range(n if words is not None else 0):
        known = words.select(*[F.col(g).alias(f"_{j}") for j, g in enumerate(group)], F.col("w1").alias("_w"))
        same = [F.col(g).eqNullSafe(F.col(f"_{j}")) for j, g in enumerate(group)]
        inner = inner.join(F.broadcast(known), reduce(lambda a, b: a & b, same, F.col(f"w{i + 1}").eqNullSafe(F.col("_w"))), "left_semi")
    return inner.groupBy(*group, *[f"w{i + 1}" for i in range(n)]).agg(F.count(F.lit(1)).alias("n"))


#: The most frequent words of a class, whose n-grams say how frequent the k-th n-gram is at least.
HEADS = 64


def top_ngrams_by_class(
    df: DataFrame, id_col: str, tokens_col: str, class_col: str, sizes: list[int], k: int = 20, scope: str = "corpus"
) -> DataFrame:
    """Most frequent n-grams per class and size; each class is one token stream in id order.

    After Agrawal & Srikant 1994: no n-gram is more frequent than its rarest word.  Those of a class's
    most frequent words are counted first; the k-th of them bounds what the class's k best reach, and
    words below that bound cannot be part of these.  Where too many words are left, all count.
    """
    singles = stage(ngram_counts(df, id_col, tokens_col, 1, [class_col]), "singles")
    heads = stage(top_k(singles, [class_col], [F.col("n").desc(), F.col("w1").asc()], HEADS), "heads")
    parts = None
    for size in sizes:
        names = [f"w{i + 1}" for i in range(size)]
        kept = _able_words(df, id_col, tokens_col, class_col, size, k, singles, heads) if size > 1 else None
        counts = singles if size == 1 else ngram_counts(df, id_col, tokens_col, size, [class_col], scope, kept)
        part = counts.select(class_col, F.lit(size).alias("size"), F.concat_ws(" ", *names).alias("ngram"), "n")
        parts = part if parts is None else parts.unionByName(part)
    return top_k(parts, [class_col, "size"], [F.col("n").desc(), F.col("ngram").asc()], k)


def _able_words(df: DataFrame, id_col: str, tokens_col: str, class_col: str, size: int, k: int, singles: DataFrame, heads: DataFrame) -> DataFrame | None:
    """(class, w1): the words frequent enough for the ``k`` best n-grams; None if they are too many."""
    if not fits_broadcast(heads):
        return None
    sure = ngram_counts(df, id_col, tokens_col, size, [class_col], "document", heads)
    best = top_k(sure, [class_col], [F.col("n").desc(), *[F.col(f"w{i + 1}").asc() for i in range(size)]], k)
    least = best.groupBy(F.col(class_col).alias("_class")).agg(F.when(F.count(F.lit(1)) >= k, F.min("n")).alias("_least"))
    bounded = singles.join(small_side(stage(least, "least")), F.col(class_col).eqNullSafe(F.col("_class")), "left")
    kept = stage(bounded.where(F.col("n") >= F.coalesce("_least", F.lit(1))).select(class_col, "w1"), "able")
    return kept if fits_broadcast(kept) else None


def collocations(
    df: DataFrame, id_col: str, tokens_col: str, size: int, k: int = 20, min_frequency: int = 3, scope: str = "corpus"
) -> DataFrame:
    """n-grams of at least ``min_frequency`` with the highest pointwise mutual information."""
    words = [f"w{i + 1}" for i in range(size)]
    unigrams = stage(term_counts(df, tokens_col, "word", "c"), "unigrams")
    total = unigrams.agg(F.sum("c")).first()[0] or 0
    # the n-grams are counted once; the lookups below read them for their hot words as well
    frequent = stage(ngram_counts(df, id_col, tokens_col, size, [], scope).where(F.col("n") >= min_frequency), "ngrams")
    grams = frequent
    for w in words:
        side = unigrams.select(F.col("word").alias(w), F.col("c").alias(f"c_{w}"))
        grams = lookup_join(grams, side, [w], salt_by=words, counts=key_counts(frequent, [w]))
    expected = F.lit(1.0)
    for w in words:
        expected = expected * F.col(f"c_{w}")
    pmi = F.round(F.log2(F.col("n") * F.pow(F.lit(float(total)), F.lit(size - 1.0)) / expected), 6)
    # candidates share one total order; map tasks keep k each before the last k are chosen
    order = [F.col("pmi").desc(), *[F.col(w).asc() for w in words]]
    return grams.select(*words, "n", pmi.alias("pmi")).orderBy(*order).limit(k)


# ---------------------------------------------------------------- co-occurrence

def cooccurrence_pairs(df: DataFrame, tokens_col: str, window: int = 2, among: list[str] | None = None) -> DataFrame:
    """Unordered neighbour pairs (a < b, n) at most ``window`` apart inside a row; equal words skipped.
    With ``among``, a short list, only pairs of its words are counted.

    Pairs are counted by the numbers of their words within ``PAIRED`` words of an Arrow batch first."""
    known = None if among is None else pa.array(among, pa.string())
    counted = df.select(tokens_col).mapInArrow(lambda batches: (_pair_counts(part, window, known) for b in batches for part in _lists(b.column(0))), "x string, y string, n long")
    return counted.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"))


#: Words whose pairs are held at a time; a longer row is a part of its own.
PAIRED = 1_000_000


def _lists(rows: pa.Array) -> Iterator[pa.Array]:
    """The rows of a list column in parts of about ``PAIRED`` elements."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy())
    at = 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PAIRED, "right")))
        yield rows.slice(at, end - at)
        at = end


def _pair_counts(rows: pa.Array, window: int, among: pa.Array | None) -> pa.RecordBatch:
    """(x, y, n): the pairs of different words of these rows, in one of their two orders."""
    owner = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy())
    coded = rows.flatten().dictionary_encode()
    names = coded.dictionary
    code = pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64)
    if among is not None and len(names):
        inside = pc.is_in(names, value_set=among.cast(names.type)).to_numpy(zero_copy_only=False)
        code[~inside[code]] = -1
    found = [np.empty(0, np.int64)]
    for d in range(1, window + 1):
        x, y = code[:-d], code[d:]
        real = np.flatnonzero((owner[:-d] == owner[d:]) & (x != y) & (x >= 0) & (y >= 0))
        x, y = x[real], y[real]
        found.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
    pairs, n = np.unique(np.concatenate(found), return_counts=True)
    x, y = np.divmod(pairs, max(len(names), 1))
    ends = [names.take(pa.array(v)).cast(pa.string()) for v in (x, y)]
    return pa.RecordBatch.from_arrays([*ends, pa.array(n, pa.int64())], names=["x", "y", "n"])


def cooccurrence(df: DataFrame, tokens_col: str, window: int = 2, best: int | None = None) -> DataFrame:
    """Directed edges (token, context, n).  Every pair counts the same in both directions, so the
    shuffle carries it once and the mirror edge is added afterwards.  With ``best`` edges that cannot be
    among so many heaviest may be missing; ``df``, best a staged table, is then read three times."""
    among = None if best is None else _linked_words(df, tokens_col, window, best)
    both = F.array(
        F.struct(F.col("a").alias("token"), F.col("b").alias("context")),
        F.struct(F.col("b").alias("token"), F.col("a").alias("context")),
    )
    return cooccurrence_pairs(df, tokens_col, window, among).select(F.inline(both), "n").select("token", "context", "n")


#: As many words as a filter of tokens lists at most.
LISTED = 10_000


def _linked_words(df: DataFrame, tokens_col: str, window: int, best: int) -> list[str] | None:
    """The words frequent enough for the ``best`` heaviest edges; None if they are too many to list.

    As in ``top_ngrams_by_class``: the edges of the most frequent words say what the last of the best
    weighs at least.  An occurrence of a word has 2 * ``window`` places beside it, so no edge weighs
    more than so many times its rarer word.
    """
    terms = stage(term_counts(df, tokens_col).where(F.col("term").isNotNull()), "terms")
    heads = [r["term"] for r in terms.orderBy(F.col("n").desc(), F.col("term").asc()).limit(HEADS).collect()]
    # a pair is two edges of the same weight
    pairs = cooccurrence_pairs(df, tokens_col, window, heads).orderBy(F.col("n").desc()).limit(-(-best // 2))
    found = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).first()
    if 2 * found["pairs"] < best:
        return None
    able = terms.where(2 * window * F.col("n") >= F.lit(found["least"])).select("term").limit(LISTED + 1).collect()
    return [r["term"] for r in able] if len(able) <= LISTED else None


def top_edges(edges: DataFrame, k: int = 50, directed: bool = True) -> DataFrame:
    """The k heaviest directed edges, or (``directed=False``) those edges collapsed to pairs.

    The customary drawing takes the top directed edges first and then merges mirror edges.
    """
    top = edges.orderBy(F.col("n").desc(), F.col("token").asc(), F.col("context").asc()).limit(k)
    if directed:
        return top
    return top.select(F.least("token", "context").alias("a"), F.greatest("token", "context").alias("b"), "n").distinct()


def closest_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(token, neighbour): the ``k`` most frequent contexts of every token (ties: first in order)."""
    named = edges.withColumnRenamed("context", "neighbour")
    return top_k(named, ["token"], [F.col("n").desc(), F.col("neighbour").asc()], k).select("token", "neighbour")


def top_neighbours(edges: DataFrame) -> DataFrame:
    """Most frequent context of every token (ties: first in order)."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("context").alias("neighbour")))
    return edges.groupBy("token").agg(best.alias("_best")).select("token", "_best.neighbour")


# ---------------------------------------------------------------- TF-IDF and vocabulary

def _idf(docs: Column, df: Column) -> Column:
    return F.log((1.0 + docs) / (1.0 + df)) + 1.0


def _with_norms(weighted: DataFrame, id_col: str, weights: list[str]) -> DataFrame:
    """Divide each weight by its row's L2 norm; a window holds one document's distinct terms."""
    row = Window.partitionBy(id_col)
    return weighted.withColumns({w: F.col(w) / F.sqrt(F.sum(F.col(w) * F.col(w)).over(row)) for w in weights})


def _weighted(df: DataFrame, id_col: str, keep: list[str], tokens_col: str, idf: DataFrame, on: list[str], min_length: int) -> DataFrame:
    """(id, keep, term, tf, idf columns).

    Rows are placed by id once, as compact token lists; counting the terms, a broadcast lookup and
    the norm over a document then need no further shuffle.  Beside a larger lookup a key has ``df`` rows.
    """
    tf = document_terms(df.repartition(id_col), [id_col, *keep], tokens_col).where(F.length("term") >= min_length)
    return lookup_join(tf, idf.drop("df"), on, salt_by=[id_col], counts=idf.select(*on, F.col("df").alias("_facts")))


def _document_frequency(df: DataFrame, group: list[str], tokens_col: str, min_length: int) -> DataFrame:
    """(group, term, df) from each row's distinct tokens; counts combine map-side."""
    terms = df.select(*group, F.explode(F.array_distinct(tokens_col)).alias("term"))
    return terms.where(F.length("term") >= min_length).groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_overall(df: DataFrame, id_col: str, tokens_col: str, min_length: int = 2) -> DataFrame:
    """Mean L2-normalised TF-IDF of every term over all rows: (term, score)."""
    docs = df.count()
    frequency = _document_frequency(df, [], tokens_col, min_length)
    idf = stage(frequency.select("term", "df", _idf(F.lit(docs), F.col("df")).alias("idf")), "idf")
    weighted = _weighted(df, id_col, [], tokens_col, idf, ["term"], min_length).select(
        id_col, "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    return _with_norms(weighted, id_col, ["w"]).groupBy("term").agg((F.sum("w") / F.lit(docs)).alias("score"))


def tfidf_by_class(
    df: DataFrame, id_col: str, tokens_col: str, class_col: str, k: int = 20, min_length: int = 2
) -> DataFrame:
    """Top terms per class (and 'all') by class mean TF-IDF minus overall mean.

    IDF of a class is fitted on that class alone, the vocabulary is shared.  Each bag-of-words row
    carries its class weight and its overall weight together, so the corpus is walked once
    instead of once per class.  Only (class, term) pairs that occur are scored.  A term that a class
    lacks scores minus its overall mean there, so no class needs such a term whose ``k`` best pairs all
    lie above the best of these; the others look through as many terms as they have, plus ``k``.
    Rows without a class take no part.
    """
    df = df.where(F.col(class_col).isNotNull())
    sizes = stage(df.groupBy(F.col(class_col)).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    docs = sizes.agg(F.sum("_size").alias("n")).first()["n"] or 0
    per_class = _document_frequency(df, [class_col], tokens_col, min_length)
    # at most one row per class meets in a term's window
    by_term = Window.partitionBy("term")
    frequency = per_class.withColumn("df_all", F.sum("df").over(by_term)).join(small_side(sizes), class_col)
    idf = stage(
        frequency.select(
            class_col, "term", "df", _idf(F.col("_size"), F.col("df")).alias("idf"), _idf(F.lit(docs), F.col("df_all")).alias("idf_all")
        ),
        "idf",
    )
    weighted = _weighted(df, id_col, [class_col], tokens_col, idf, [class_col, "term"], min_length).select(
        id_col, class_col, "term", (F.col("tf") * F.col("idf")).alias("w"), (F.col("tf") * F.col("idf_all")).alias("w_all")
    )
    sums = _with_norms(weighted, id_col, ["w", "w_all"]).groupBy(class_col, "term").agg(
        F.sum("w").alias("s"), F.sum("w_all").alias("s_all")
    )
    pairs = sums.withColumn("o", F.sum("s_all").over(by_term) / F.lit(docs)).join(small_side(sizes), class_col)
    pairs = stage(pairs.select(F.col(class_col).alias("class"), "term", (F.col("s") / F.col("_size")).alias("s"), "o"), "pairs")
    terms = stage(pairs.groupBy("term").agg(F.first("o").alias("o")), "terms")

    def scored(rows: DataFrame, score: Column) -> DataFrame:
        figures = {"score": score, "score_all": F.col("o"), "score_diff": score - F.col("o")}
        # adding zero makes a negative zero a plain one, as ties go by term
        return rows.select("class", "term", *[(F.round(v, 6) + F.lit(0.0)).alias(n) for n, v in figures.items()])

    order = [F.col("score_diff").desc(), F.col("term").asc()]
    rows = scored(pairs, F.col("s")).unionByName(scored(terms.withColumn("class", F.lit("all")), F.col("o")))
    held = top_k(rows, ["class"], order, k).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("score_diff").alias("least"))
    absent = terms.agg(F.max(F.round(-F.col("o"), 6) + F.lit(0.0)).alias("d")).first()["d"]
    lacking = sizes.select(F.col(class_col).alias("class")).join(held, "class", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("least") <= F.lit(absent)))
    lacking = stage(lacking.select("class"), "lacking")
    if lacking.isEmpty():
        return top_k(rows, ["class"], order, k)
    own = stage(lookup_join(pairs.select("class", "term"), lacking, ["class"], salt_by=["term"]), "own")
    reach = lacking.join(own.groupBy("class").agg(F.count(F.lit(1)).alias("m")), "class", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    placed = row_positions(terms.withColumn("d", F.round(-F.col("o"), 6) + F.lit(0.0)), [], [F.col("d").desc(), F.col("term").asc()], "pos")
    tried = stage(reach.select("class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + k - 1)).alias("pos")), "tried")
    missing = lookup_join(tried, stage(placed.select("pos", "term", "o"), "placed"), ["pos"], salt_by=["class"]).join(own, ["class", "term"], "left_anti")
    return top_k(rows.unionByName(scored(missing, F.lit(0.0))), ["class"], order, k)


def vocabulary(
    df: DataFrame, id_col: str, tokens_col: str, no_below: int = 5, no_above: float = 0.5, keep: int | None = None
) -> DataFrame:
    """Terms in at least ``no_below`` rows and at most a share ``no_above`` of them; with ``keep``
    only that many, the most frequent (ties by term)."""
    docs = df.count()
    frequency = _document_frequency(df, [], tokens_col, 1)
    kept = frequency.where((F.col("df") >= no_below) & (F.col("df") <= no_above * docs))
    if keep is None:
        return kept
    # a global top of this size would merge in one task; positions come from range blocks instead
    placed = row_positions(kept, [], [F.col("df").desc(), F.col("term").asc()], "_pos")
    return placed.where(F.col("_pos") < keep).drop("_pos")


# ---------------------------------------------------------------- language detection

UNDETECTED = "xxx"


def _word_grams(words: DataFrame, keep: list[str]) -> DataFrame:
    """1- to 3-character grams of the space-padded word; the lone space is no gram."""
    padded = F.concat(F.lit(" "), F.col("term"), F.lit(" "))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - n + 1)
        return F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))

    # a padded word has at least three characters
    every = F.flatten(F.array(grams(1), grams(2), grams(3)))
    return words.select(*keep, F.explode(every).alias("gram")).where(F.col("gram") != " ")


def language_profiles(df: DataFrame, tokens_col: str, lang_col: str) -> DataFrame:
    """Smoothed log-probability of every character gram per language: (lang, gram, n, logp).

    Words are counted first, so grams are cut from each distinct word once.
    """
    words = df.select(lang_col, F.explode(tokens_col).alias("term")).groupBy(lang_col, "term").agg(
        F.count(F.lit(1)).alias("n")
    )
    languages = class_values(df, lang_col)
    counts = stage(
        _word_grams(words, [lang_col, "n"]).groupBy("gram").agg(
            *[F.coalesce(F.sum(F.when(F.col(lang_col) == c, F.col("n"))), F.lit(0)).alias(f"n_{i}") for i, c in enumerate(languages)]
        ),
        "grams",
    )
    totals = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{i}").alias(f"t_{i}") for i in range(len(languages))]).first()
    cells = [
        F.struct(
            F.lit(c).alias("lang"),
            F.col(f"n_{i}").alias("n"),
            F.log((F.col(f"n_{i}") + 1.0) / F.lit(float((totals[f"t_{i}"] or 0) + totals["v"]))).alias("logp"),
        )
        for i, c in enumerate(languages)
    ]
    return counts.select("gram", F.inline(F.array(*cells))).select("lang", "gram", "n", "logp")


def detect_language(df: DataFrame, id_col: str, tokens_col: str, profiles: DataFrame) -> DataFrame:
    """Most probable language per row: (id, detected, logp of it per gram); no known gram gives 'xxx'.

    Each distinct word is scored once against the profiles; rows then add up their words' scores.
    """
    languages = class_values(profiles, "lang")
    wide = stage(
        profiles.groupBy("gram").agg(
            *[F.max(F.when(F.col("lang") == c, F.col("logp"))).alias(f"s_{i}") for i, c in enumerate(languages)]
        ),
        "profile",
    )
    words = df.select(F.explode(tokens_col).alias("term")).distinct()
    names = [f"s_{i}" for i in range(len(languages))]
    scored = lookup_join(_word_grams(words, ["term"]), wide, ["gram"], salt_by=["term"]).groupBy("term").agg(
        *[F.sum(s).alias(s) for s in names], F.count(F.lit(1)).alias("grams")
    )
    hits = token_lookup(df, [id_col], tokens_col, stage(scored, "words"), salt_by=[id_col])
    sums = hits.groupBy(id_col).agg(
        *[(F.sum(F.col(s) * F.col("n")) / F.sum(F.col("grams") * F.col("n"))).alias(s) for s in names]
    )
    ranked = sums.withColumn("_scores", F.array(*[F.round(s, 9) for s in names]))
    best = ranked.select(
        id_col,
        F.element_at(F.array(*[F.lit(c) for c in languages]), argmax(F.col("_scores")) + 1).alias("detected"),
        F.round(F.array_max("_scores"), 6).alias("mean_logp"),
    )
    return df.select(id_col).join(best, id_col, "left").withColumn("detected", F.coalesce("detected", F.lit(UNDETECTED)))


# ---------------------------------------------------------------- augmentation

def augment_minorities(
    df: DataFrame,
    id_col: str,
    tokens_col: str,
    class_col: str,
    neighbours: DataFrame,
    seed: int = 12345,
    share: int = 30,
) -> DataFrame:
    """New texts that lift every class to the size of the largest: (class, copy, source id, text).

    Each missing row copies a hash-chosen source row of its class (with replacement) and replaces
    about ``share`` percent of its tokens by their closest neighbour; copies without text drop out.
    """
    found = stage(neighbours, "neighbours")
    return _augmented(df, id_col, tokens_col, class_col, lambda words: lookup_join(words, found, ["token"], salt_by=["source_id", "i"], how="left"), seed, share)


def augment_in_context(
    df: DataFrame, id_col: str, tokens_col: str, class_col: str, candidates: DataFrame, seed: int = 12345, share: int = 30
) -> DataFrame:
    """Like ``augment_minorities``, but of the ``candidates`` (token, neighbour) of a word the one that fits
    best between the words on its left and right, by a back-off model of the rows' own bigrams.
    ``df``, best a staged table, is read four times."""
    rows = df.select(id_col, class_col, tokens_col)
    single = stage(term_counts(rows, tokens_col), "unigrams")
    total = single.agg(F.sum("n").alias("n")).first()["n"] or 1
    near = stage(candidates.select("token", F.col("neighbour").alias("other")), "near")
    known = lookup_join(near, single.select(F.col("term").alias("other"), F.col("n").alias("n_other")), ["other"], salt_by=["token"], how="left")
    listed = stage(known.groupBy("token").agg(F.collect_list(F.struct("other", "n_other")).alias("others")), "candidates")
    discard(near)
    last = F.greatest(F.size(tokens_col) - 1, F.lit(0))
    follow = F.arrays_zip(F.slice(tokens_col, F.lit(1), last).alias("x"), F.slice(tokens_col, F.lit(2), last).alias("y"))
    pairs = stage(rows.select(F.inline(follow)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "bigrams")

    def fitted(words: DataFrame) -> DataFrame:
        best = _fitting(words, listed, single, pairs, total)
        discard(pairs)
        return lookup_join(words, best, ["left", "token", "right"], salt_by=["source_id", "i"], how="left")

    return _augmented(rows, id_col, tokens_col, class_col, fitted, seed, share)


#: What a bigram that never occurs keeps of its last word's share (Brants et al. 2007), and the mark of a text's ends.
BACK_OFF, EDGE = 0.4, ""


def _fitting(words: DataFrame, listed: DataFrame, single: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """(left, token, right, neighbour): the best candidate of every distinct context, ties by word.

    A candidate's score is its share after the left word times the right word's share after it.  The
    first factor is worked out per pair of left word and token, the other one per pair of token and
    right word, as there are far fewer pairs than contexts; a context meets the lists of both.
    """
    whole = F.lit(float(total))
    alone = F.col("n_other") / whole
    after = pairs.select(F.col("x").alias("left"), F.col("y").alias("other"), F.col("n").alias("n_pair"))
    before = pairs.select(F.col("x").alias("other"), F.col("y").alias("right"), F.col("n").alias("n_pair"))
    first = F.when(F.col("left") == EDGE, alone).otherwise(F.coalesce(F.col("n_pair") / F.col("n_beside"), BACK_OFF * alone))
    second = F.when(F.col("right") == EDGE, F.lit(1.0)).otherwise(F.coalesce(F.col("n_pair") / F.col("n_other"), BACK_OFF * (F.col("n_beside") / whole)))

    contexts = stage(words.select("left", "token", "right").distinct(), "contexts")
    lists = {}
    for beside, table, factor in (("left", after, first), ("right", before, second)):
        seen = stage(contexts.select(beside, "token").distinct(), "seen")
        # the first lookup keeps all rows, so hot words are counted in the rows before it
        each = lookup_join(seen, single.select(F.col("term").alias(beside), F.col("n").alias("n_beside")), [beside], salt_by=["token"], how="left")
        each = lookup_join(each, listed, ["token"], salt_by=[beside], counts=key_counts(seen, ["token"]))
        each = stage(each.select(beside, "token", "n_beside", F.inline("others")), "fitted")
        discard(seen)
        scored = lookup_join(each, table, [beside, "other"], salt_by=["token"], how="left")
        factors = F.array_sort(F.collect_list(F.struct("other", factor.alias("f"))))
        lists[beside] = stage(scored.groupBy(beside, "token").agg(factors.alias(f"{beside}_f")), "factors")
        discard(each)
    joined = lookup_join(contexts, lists["left"], ["left", "token"], salt_by=["right"])
    joined = lookup_join(joined, lists["right"], ["token", "right"], salt_by=["left"], counts=key_counts(contexts, ["token", "right"]))
    # both lists hold the token's candidates in order
    best = F.array_min(F.zip_with("left_f", "right_f", lambda x, y: F.struct((-(x["f"] * y["f"])).alias("score"), x["other"].alias("other"))))
    fitting = stage(joined.select("left", "token", "right", best["other"].alias("neighbour")), "fitting")
    discard(contexts, *lists.values())
    return fitting


def _augmented(
    df: DataFrame, id_col: str, tokens_col: str, class_col: str, replace: Callable[[DataFrame], DataFrame], seed: int, share: int
) -> DataFrame:
    """The copies; ``replace`` adds ``neighbour`` to words (source_id, i, token, left, right)."""
    deficits = stage(class_deficits(df, class_col), "deficits")
    copies = numbered_copies(deficits.select(class_col, "n", "deficit"), "deficit", "copy")
    picks = copies.select(
        class_col, "copy", F.pmod(hash_number(F.lit(seed), F.col(class_col), F.col("copy")), F.col("n")).alias("_pos")
    )
    # only ids are put in order; the texts join when their copies are known
    sources = row_positions(df.select(class_col, F.col(id_col).alias("source_id")), [class_col], [F.col("source_id").asc()], "_pos")
    # a small class with a large deficit draws the same sources again and again: copies salt both joins
    chosen = stage(lookup_join(picks, stage(sources, "sources"), [class_col, "_pos"], salt_by=["copy"]).drop("_pos"), "chosen")
    # every source text meets the neighbours once, however many copies it has; one group is one text
    used = df.select(F.col(id_col).alias("source_id"), tokens_col).join(chosen.select("source_id").distinct(), "source_id", "left_semi")
    used = stage(used, "used")
    tokens = F.col(tokens_col)
    beside = lambda i, d: F.coalesce(F.get(tokens, i + d), F.lit(EDGE))
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("token"), beside(i, -1).alias("left"), beside(i, 1).alias("right")))
    paired = replace(used.select("source_id", F.inline(placed)))
    texts = paired.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "token", F.coalesce("neighbour", "token").alias("other")))).alias("_words")
    )
    # three flat lists take a fraction of the bytes of one list of structs
    texts = stage(texts.select("source_id", *[F.col(f"_words.{c}").alias(f"_{c}") for c in ("i", "token", "other")]), "texts")
    discard(used)

    copied = lookup_join(chosen, texts, ["source_id"], salt_by=["copy"])
    start = F.concat_ws("|", F.lit(seed).cast("string"), F.col(class_col).cast("string"), F.col("copy").cast("string"), F.lit(""))
    text = _diced(share)(start, F.col("_i"), F.col("_token"), F.col("_other"))
    return copied.select(class_col, "copy", "source_id", text.alias("text")).where(F.trim("text") != "")


def _diced(share: int) -> Callable[..., Column]:
    """The words' text, a word being the other one where ``hash_number`` of the text's start and the
    word's place, modulo 100, is below ``share``.

    One digest per copied word is most of the work; a nested expression takes several times as long.
    """

    def some(start: pa.Array, places: pa.Array, tokens: pa.Array, others: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy()
        dice = hash_numbers(start.to_pylist(), sizes, places.flatten().to_numpy()) % 100
        words = pc.if_else(pa.array(dice < share), others.flatten(), tokens.flatten())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), words)
        if words.null_count:
            return pa.array([" ".join(w for w in row if w is not None) for row in lists.to_pylist()], pa.string())
        return pc.binary_join(lists, " ")

    def run(*columns: pa.Array) -> pa.Array:
        parts = [some(*[c.slice(at, TEXTS) for c in columns]) for at in range(0, len(columns[0]), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    # bare types keep Spark from asking for the types of postponed annotations
    run.__annotations__ = dict.fromkeys(("columns", "return"), pa.Array)
    return F.arrow_udf(run, "string")


#: Texts whose words are hashed at a time.
TEXTS = 256


def balanced_corpus(df: DataFrame, id_col: str, tokens_col: str, class_col: str, neighbours: DataFrame, seed: int = 12345, share: int = 30) -> DataFrame:
    """The originals united with the copies that lift every class: (class, copy, source id, text, is_new).

    An original has no copy number and its tokens as text.
    """
    originals = df.select(
        class_col, F.lit(None).cast("long").alias("copy"), F.col(id_col).alias("source_id"), F.array_join(tokens_col, " ").alias("text"), F.lit(False).alias("is_new")
    )
    copies = augment_minorities(df, id_col, tokens_col, class_col, neighbours, seed, share)
    return originals.unionByName(copies.withColumn("is_new", F.lit(True)))
