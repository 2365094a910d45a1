"""Text cleaning, tokens and per-text features on the documents table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import ENTITY_LANGUAGES, LANGUAGE_NAMES, TAG_LANGUAGES, recorded_stop_words, stop_words
from ..operators import features, gazetteer, profile
from ..plans.ordering import exact_quantiles
from ..plans.staging import stage
from .base import SQL_TERM, SQL_TOK, SQL_TOKENS, documents, labelled, query, table, tokenized

# ---------------------------------------------------------------- personal data
# The oracle's regex engine knows ASCII word boundaries only.  Between an ASCII word character and
# an accented letter it therefore gets a '_' (no text holds one), which is taken out again before
# the patterns over whole words; those name the character before a match instead of a boundary.

_ACCENT = r"[\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02C1}\x{0370}-\x{1FFF}]"
_W = r"[\p{L}\p{M}\p{N}_]"
_BEFORE = r"(^|[^\p{L}\p{M}\p{N}_])"


def _sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', {to}, 'g')"


def _mark(expr: str) -> str:
    one = _sub(expr, rf"([A-Za-z0-9_])({_ACCENT})", r"'\1_\2'")
    return _sub(one, rf"({_ACCENT})([A-Za-z0-9_])", r"'\1_\2'")


def _unmark(expr: str) -> str:
    one = _sub(expr, rf"([A-Za-z0-9])_({_ACCENT})", r"'\1\2'")
    return _sub(one, rf"({_ACCENT})_([A-Za-z0-9])", r"'\1\2'")


# fixed values: the same patterns as in functions/text.py
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_PHONE = r"\b(\+?\d[-.\s()]*\d{3}[-.\s()]*(?:\d{2,}[-.\s()]*)?\d{2,})\b"
_STREET = (
    r"\b\d+\s+([A-Za-z]+\s*){1,4}"
    r"(Street|St|Rd|Road|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Square|Sq)\b"
)


def _emails(expr: str, domain: str) -> str:
    fenced = _sub(expr, f"({_EMAIL})", r"chr(1) || '\1' || chr(2)")
    ours = f"regexp_replace({fenced}, chr(1) || '[^' || chr(2) || ']*{domain.replace('.', chr(92) + '.')}' || chr(2), '{X.OWN_MASK}', 'g')"
    return f"regexp_replace({ours}, chr(1) || '[^' || chr(2) || ']*' || chr(2), '{X.OTHER_MASK}', 'g')"


def _sql_mask(mode: str) -> str:
    def links(e: str) -> str:
        e = _sub(e, r"https?://\S+", "'<some_url>'")
        e = _sub(e, r"<[^>]+>", "'<some_url>'")
        return _sub(e, r"\.s\.hubspotemail\.net/[^ ]+", "'<some_url>'")

    def places(e: str) -> str:
        e = _sub(e, rf"{_BEFORE}\d+\s+{_W}+\s+{_W}+", r"'\1<some_address>'")
        e = _sub(e, rf"{_BEFORE}\d+{_W}*(?:[-/]\s*|\s+)\d+{_W}*\s+{_W}+\s+{_W}+", r"'\1<some_address>'")
        e = _sub(e, r"(P\.O\. Box|PO Box)\s+\d+", "'<some_address>'")
        return _sub(e, rf"{_BEFORE}{_W}+(?:\s*,\s*|\s+){_W}{{2}}\s+\d{{5}}(-\d{{4}})?", r"'\1<some_address>'")

    text = links("text") if mode == "clean" else "text"
    text = _sub(_mark(text), _PHONE, "'<someones_phone_number>'")
    text = _unmark(_sub(_emails(text, X.OWN_DOMAIN), _STREET, "'<some_address>'"))
    return places(links(text) if mode == "strict" else text)


@query("pii_masked", f"SELECT doc_id, {_sql_mask('strict')} AS masked FROM documents")
def pii_masked(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.mask_pii(F.col("text")).alias("masked"))


@query("pii_masked_clean", f"SELECT doc_id, {_sql_mask('clean')} AS masked FROM documents")
def pii_masked_clean(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.mask_pii(F.col("text"), mode="clean").alias("masked"))


@query(
    "pii_email_split",
    f"""WITH m AS (SELECT doc_id, text, {_unmark(_emails(_mark('text'), 'mail1.example.com'))} AS masked FROM documents)
SELECT doc_id, masked, len(regexp_extract_all(masked, 'rep@saascompany'))::BIGINT AS own,
  len(regexp_extract_all(masked, 'prospect@somemail'))::BIGINT AS other FROM m""",
)
def pii_email_split(spark, sf_dir):
    masked = documents(spark, sf_dir).select(
        "doc_id", X.mask_emails(F.col("text"), own_domain="mail1.example.com").alias("masked")
    )
    return masked.select(
        "doc_id",
        "masked",
        F.regexp_count("masked", F.lit("rep@saascompany")).cast("long").alias("own"),
        F.regexp_count("masked", F.lit("prospect@somemail")).cast("long").alias("other"),
    )


def _sql_count(pattern: str) -> str:
    return f"sum(len(regexp_extract_all(t, '{pattern}')))::BIGINT"


@query(
    "pii_profile",
    f"""WITH m AS (
  SELECT lang AS class, {_mark('text')} AS t FROM documents
  UNION ALL SELECT 'page' AS class, {_mark('html')} AS t FROM pages)
SELECT class, count(*) AS docs, {_sql_count(_PHONE)} AS phone, {_sql_count(_EMAIL)} AS email,
  {_sql_count(_STREET)} AS street, {_sql_count(r'https?://[^ ]+')} AS url, {_sql_count('<[^>]+>')} AS tag,
  {_sql_count(r'(P\.O\. Box|PO Box)\s+\d+')} AS po_box
FROM m GROUP BY class""",
)
def pii_profile(spark, sf_dir):
    texts = documents(spark, sf_dir).select(F.col("lang").alias("class"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("class"), F.col("html").alias("text"))
    counted = texts.unionByName(pages).select("class", *[c.alias(k) for k, c in X.count_pii(F.col("text")).items()])
    return counted.groupBy("class").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(k).cast("long").alias(k) for k in X.PII_KINDS]
    )


# ---------------------------------------------------------------- tokens

@query("tokens", f"SELECT doc_id, len(tokens)::BIGINT AS n, array_to_string(tokens, ' ') AS tokens FROM (SELECT doc_id, {SQL_TOKENS} AS tokens FROM documents)")
def tokens(spark, sf_dir):
    t = tokenized(spark, sf_dir)
    return t.select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


STOP_LANGUAGES = ["de", "en", "es", "fr"]


def _sql_stop_words() -> str:
    rows = ", ".join(
        "('{}', '{}')".format(lang, w.replace("'", "''")) for lang in STOP_LANGUAGES for w in recorded_stop_words(lang)
    )
    return f"stop(lang, w) AS (VALUES {rows})"


@query(
    "tokens_no_stop",
    f"""WITH {SQL_TERM}, {_sql_stop_words()},
kept AS (SELECT doc_id, w, i FROM term t WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.lang = t.lang AND s.w = t.w)),
joined AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS tokens FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(tokens, '') AS tokens FROM documents d LEFT JOIN joined USING (doc_id)""",
)
def tokens_no_stop(spark, sf_dir):
    t = tokenized(spark, sf_dir, "lang")
    kept = t.select("doc_id", X.without_stop_words(F.col("tokens"), F.col("lang"), stop_words(STOP_LANGUAGES)).alias("tokens"))
    return kept.select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query(
    "token_text",
    f"SELECT doc_id, lang, array_to_string({SQL_TOKENS}, ' ') AS processed_text FROM documents",
)
def token_text(spark, sf_dir):
    return tokenized(spark, sf_dir, "lang").select("doc_id", "lang", F.array_join("tokens", " ").alias("processed_text"))


@query(
    "cttr",
    f"""WITH {SQL_TOK} SELECT doc_id, round(CASE WHEN len(tokens) = 0 THEN 0.0
  ELSE len(list_distinct(tokens)) / sqrt(len(tokens)) END, 6) AS cttr FROM tok""",
)
def cttr(spark, sf_dir):
    return tokenized(spark, sf_dir).select("doc_id", F.round(X.root_ttr(F.col("tokens")), 6).alias("cttr"))


def _sql_mtld(tokens: str) -> str:
    """Fold of the token list: finished factors f, length n and types s of the running one."""
    seen = "CASE WHEN list_contains(a.s, x.s[1]) THEN a.s ELSE list_append(a.s, x.s[1]) END"
    step = f"""CASE WHEN a.n + 1 >= 10 AND len({seen}) / (a.n + 1) < 0.72::DOUBLE THEN {{'f': a.f + 1, 'n': 0::BIGINT, 's': []::VARCHAR[]}}
      ELSE {{'f': a.f, 'n': a.n + 1, 's': {seen}}} END"""
    items = f"list_transform({tokens}, lambda w: {{'f': 0::DOUBLE, 'n': 0::BIGINT, 's': [w]}})"
    return f"list_reduce({items}, lambda a, x: {step}, {{'f': 0::DOUBLE, 'n': 0::BIGINT, 's': []::VARCHAR[]}})"


_SQL_FACTORS = "{r}.f + CASE WHEN {r}.n > 0 THEN (1 - len({r}.s) / {r}.n) / (1 - 0.72::DOUBLE) ELSE 0 END"


@query(
    "mtld",
    f"""WITH {SQL_TOK}, r AS (SELECT doc_id, len(tokens) AS n, {_sql_mtld('tokens')} AS a, {_sql_mtld('list_reverse(tokens)')} AS b FROM tok),
f AS (SELECT doc_id, n, {_SQL_FACTORS.format(r='a')} AS fa, {_SQL_FACTORS.format(r='b')} AS fb FROM r)
SELECT doc_id, round((CASE WHEN fa > 0 THEN n / fa ELSE 0 END + CASE WHEN fb > 0 THEN n / fb ELSE 0 END) / 2, 6) AS mtld FROM f""",
)
def mtld(spark, sf_dir):
    return tokenized(spark, sf_dir).select("doc_id", F.round(X.mtld(F.col("tokens")), 6).alias("mtld"))


@query(
    "token_budget",
    f"""WITH b AS (SELECT lang AS class, len(list_filter(string_split_regex(regexp_replace(lower(coalesce(trim(text), '')),
  '([;@#$%&?!*,:()\\[\\]{{}}<>"]|\\.+(?:\\s|$))', ' \\1 ', 'g'), '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}+$'))) AS n FROM documents)
SELECT class, count(*) AS docs, sum(n)::BIGINT AS total, sum(least(n, 512))::BIGINT AS kept,
  round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95,
  round(avg(CASE WHEN n > 512 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS truncated FROM b GROUP BY class""",
)
def token_budget(spark, sf_dir, limit: int = 512):
    d = documents(spark, sf_dir)
    words = X.tokens(F.coalesce(F.trim("text"), F.lit("")))
    # the texts are tokenized once; both branches read the lengths
    n = stage(d.select(F.col("lang").alias("class"), F.size(words).cast("long").alias("n")), "lengths")
    counts = n.groupBy("class").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n").alias("total"),
        F.sum(F.least("n", F.lit(limit))).alias("kept"),
        F.round(F.avg((F.col("n") > limit).cast("double")), 6).alias("truncated"),
    )
    p95 = exact_quantiles(n, ["class"], "n", {"p95": 0.95}).withColumn("p95", F.round("p95", 6))
    return counts.join(p95, "class")


# ---------------------------------------------------------------- languages

@query(
    "supported_languages",
    "SELECT lang, count(*) AS docs FROM documents WHERE lang IN ('en','es','fr','de','it','ru','zh') GROUP BY lang",
)
def supported_languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin(*ENTITY_LANGUAGES))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


def _sql_names() -> str:
    rows = ", ".join("('{}', '{}')".format(c, n.replace("'", "''")) for c, n in LANGUAGE_NAMES.items())
    return f"names(code, name) AS (VALUES {rows})"


@query(
    "language_names",
    f"""WITH {_sql_names()}, codes AS (
  SELECT lang AS code FROM documents UNION ALL SELECT substr(w, 1, 2) AS code FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT code, coalesce(name, 'unknown') AS language_name, count(*) AS n FROM codes LEFT JOIN names USING (code) GROUP BY ALL""",
)
def language_names(spark, sf_dir):
    """Codes of the documents, and two-letter word beginnings so that unknown codes occur."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    codes = table(spark, sf_dir, "documents").select(F.col("lang").alias("code")).unionByName(
        words.select(F.substring("w", 1, 2).alias("code"))
    )
    counts = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return features.language_names(counts, "code")


# ---------------------------------------------------------------- entities and tags

_SQL_KINDS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+?[0-9][0-9()./ -]{6,}[0-9]",
    "URL": r"https?://[^\s<>\"]+",
    "PROPN": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+",
}
_SQL_ENTITIES = "ent AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT doc_id, lang, unnest(regexp_extract_all(text, '{p}')) AS entity, '{k}' AS type FROM documents"
    for k, p in _SQL_KINDS.items()
) + ")"


@query(
    "entities",
    f"WITH {_SQL_ENTITIES} SELECT doc_id, type, entity, count(*) AS n FROM ent GROUP BY ALL",
)
def entities(spark, sf_dir):
    d = documents(spark, sf_dir)
    found = d.select("doc_id", F.inline(X.entities(F.col("text"), F.col("lang"), ENTITY_LANGUAGES)))
    return found.groupBy("doc_id", "type", F.col("text").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


_SQL_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda w: w <> '')"


@query(
    "gazetteer_entities",
    f"""WITH RECURSIVE tok AS MATERIALIZED (SELECT doc_id, {_SQL_WORDS.format('text')} AS t FROM documents),
src AS (SELECT {_SQL_WORDS.format('p_name')} AS t, 'PRODUCT' AS type FROM part UNION ALL SELECT {_SQL_WORDS.format('n_name')}, 'PLACE' FROM nation
  UNION ALL SELECT ({_SQL_WORDS.format('text')})[1:2], 'OPENING' FROM benchmark UNION ALL SELECT ({_SQL_WORDS.format('text')})[1:5], 'PASSAGE' FROM benchmark),
name AS MATERIALIZED (SELECT array_to_string(t, ' ') AS name, len(t) AS length, min(type) AS type FROM src WHERE len(t) > 0 GROUP BY ALL),
size AS (SELECT DISTINCT length FROM name),
gram AS (SELECT doc_id, i AS start, length, array_to_string(t[i + 1:i + length], ' ') AS name FROM (SELECT doc_id, t, unnest(range(len(t))) AS i FROM tok) JOIN size ON i + length <= len(t)),
hit AS MATERIALIZED (SELECT doc_id, start, max(length) AS length FROM gram JOIN name USING (name, length) GROUP BY ALL),
walk AS (SELECT doc_id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS r FROM hit) WHERE r = 1
  UNION ALL SELECT doc_id, start, length FROM (SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.start) AS r FROM walk w JOIN hit h ON h.doc_id = w.doc_id AND h.start >= w.start + w.length) WHERE r = 1)
SELECT walk.doc_id, walk.start::INTEGER AS start, walk.length::INTEGER AS length, gram.name AS entity, name.type FROM walk JOIN gram USING (doc_id, start, length) JOIN name ON name.name = gram.name""",
)
def gazetteer_entities(spark, sf_dir):
    """Names of the part and nation tables and openings of the benchmark's items in the documents."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    sources = [("part", "p_name", "PRODUCT", 9), ("nation", "n_name", "PLACE", 9), ("benchmark", "text", "OPENING", 2), ("benchmark", "text", "PASSAGE", 5)]
    names = [
        table(spark, sf_dir, t).select((F.slice(words(c), 1, n) if t == "benchmark" else words(c)).alias("tokens"), F.lit(kind).alias("type"))
        for t, c, kind, n in sources
    ]
    tokens = documents(spark, sf_dir).select("doc_id", words("text").alias("tokens"))
    return gazetteer.gazetteer_entities(tokens, "doc_id", "tokens", reduce(DataFrame.union, names))


@query("annotated_entities", f"WITH {_SQL_ENTITIES} SELECT doc_id, type, entity, count(*) AS n FROM ent GROUP BY ALL")
def annotated_entities(spark, sf_dir):
    """The same entities through the hook for annotators that are loaded per language."""

    def load(lang):
        if lang not in ENTITY_LANGUAGES:
            return None
        patterns = [(kind, re.compile(p, re.ASCII)) for kind, p in X.ENTITY_PATTERNS.items()]
        return lambda texts: texts.map(lambda t: [{"text": m[0], "type": kind} for kind, p in patterns for m in p.finditer(t or "")])

    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    found = features.annotate(d, load, "text", "lang", "entities", "array<struct<text string, type string>>")
    each = found.select("doc_id", F.inline("entities"))
    return each.groupBy("doc_id", "type", F.col("text").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "entity_counts",
    "SELECT doc_id, " + ", ".join(
        f"len(regexp_extract_all(text, '{p}'))::INTEGER AS \"entity_{k}\"" for k, p in _SQL_KINDS.items()
    ) + " FROM documents",
)
def entity_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    ents = d.select("doc_id", X.entities(F.col("text"), F.col("lang"), ENTITY_LANGUAGES).alias("entities"))
    return features.entity_counts(ents, "entities", types=list(X.ENTITY_PATTERNS))


@query(
    "top_entities",
    f"""WITH {_SQL_ENTITIES}, c AS (
  SELECT coalesce(lang, 'all') AS class, entity, count(*) AS n FROM ent GROUP BY GROUPING SETS ((lang, entity), (entity))),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, entity) AS rank FROM c)
SELECT class, entity, n, rank::INTEGER AS rank FROM r WHERE rank <= 10""",
)
def top_entities(spark, sf_dir):
    d = documents(spark, sf_dir)
    ents = d.select("lang", X.entities(F.col("text"), F.col("lang"), ENTITY_LANGUAGES).alias("entities"))
    return profile.top_entities(ents, "entities", "lang", 10)


_SQL_PIECES = r"""
list_filter(string_split_regex(regexp_replace(text, '([;@#$%&?!*,:()\[\]{}<>"]|\.+(?:\s|$))', ' \1 ', 'g'), '\s+'), lambda w: w <> '')"""
_SQL_TAG = r"""CASE WHEN regexp_matches(w, '^[0-9]+([.,][0-9]+)*$') THEN 'NUM' WHEN regexp_matches(w, '^\p{Lu}\p{L}*$') THEN 'PROPN'
  WHEN regexp_matches(w, '^\p{L}+$') THEN 'WORD' WHEN regexp_matches(w, '^[@#$%&<>*]+$') THEN 'SYM'
  WHEN regexp_matches(w, '^[;?!,:.()\[\]{}"]+$') THEN 'PUNCT' ELSE 'X' END"""


@query(
    "shape_tags",
    f"SELECT doc_id, array_to_string(list_transform({_SQL_PIECES}, lambda w: {_SQL_TAG}), ' ') AS tags FROM documents",
)
def shape_tags(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.array_join(X.shape_tags(F.col("text"), F.col("lang"), TAG_LANGUAGES), " ").alias("tags"))


@query(
    "tag_frequencies",
    f"""WITH p AS (SELECT lang, unnest({_SQL_PIECES}) AS w FROM documents)
SELECT coalesce(lang, 'all') AS class, {_SQL_TAG} AS tag, count(*) AS n FROM p GROUP BY GROUPING SETS ((lang, tag), (tag))""",
)
def tag_frequencies(spark, sf_dir):
    d = documents(spark, sf_dir)
    tags = d.select("lang", X.shape_tags(F.col("text"), F.col("lang"), TAG_LANGUAGES).alias("tags"))
    return profile.tag_frequencies(tags, "tags", "lang")


# ---------------------------------------------------------------- term scores

@query(
    "avg_term_score",
    f"""WITH {SQL_TERM}, dt AS (SELECT doc_id, w, count(*) AS n FROM term GROUP BY ALL),
s AS (SELECT w, avg(quality::DOUBLE) AS score FROM dt JOIN labels USING (doc_id) GROUP BY w HAVING count(*) >= 5),
m AS (SELECT doc_id, sum(score * n) / sum(n) AS v FROM dt JOIN s USING (w) GROUP BY doc_id)
SELECT d.doc_id, round(v, 6) AS avg_score FROM documents d LEFT JOIN m USING (doc_id)""",
)
def avg_term_score(spark, sf_dir, min_docs: int = 5):
    """Terms score the share of good-quality labelled documents that hold them."""
    t = stage(tokenized(spark, sf_dir), "tokens")
    # the join carries one row per document; terms are exploded after it
    held = labelled(spark, sf_dir, t).select("quality", F.explode(F.array_distinct("tokens")).alias("term"))
    scores = held.groupBy("term").agg(F.avg("quality").alias("score"), F.count(F.lit(1)).alias("n"))
    scores = stage(scores.where(F.col("n") >= min_docs).select("term", "score"), "scores")
    return features.average_term_score(t, "doc_id", "tokens", scores).withColumn("avg_score", F.round("avg_score", 6))
