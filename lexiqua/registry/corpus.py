"""Corpus statistics on the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, profile
from ..plans.staging import stage
from .base import SQL_TERM, labelled, query, sql_number, table, tokenized


@query(
    "values_by_class",
    "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL",
)
def values_by_class(spark, sf_dir):
    return profile.values_by_class(table(spark, sf_dir, "documents"), "source", "lang")


_SQL_TOP_TOKENS = f"""WITH {SQL_TERM}, c AS (SELECT lang, w AS token, count(*) AS n FROM term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c)"""


@query("top_tokens_by_class", f"{_SQL_TOP_TOKENS} SELECT lang, token, n, rank::INTEGER AS rank FROM r WHERE rank <= 20")
def top_tokens_by_class(spark, sf_dir):
    return profile.top_tokens_by_class(tokenized(spark, sf_dir, "lang"), "tokens", "lang", 20)


@query(
    "token_weights_by_class",
    f"""{_SQL_TOP_TOKENS} SELECT lang, token, n, round(n / max(n) OVER (PARTITION BY lang), 6) AS weight FROM r WHERE rank <= 200""",
)
def token_weights_by_class(spark, sf_dir):
    t = profile.token_weights_by_class(tokenized(spark, sf_dir, "lang"), "tokens", "lang", 200)
    return t.withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- n-grams

_SQL_STREAM = f"""{SQL_TERM},
seq AS MATERIALIZED (SELECT w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM term WINDOW s AS (ORDER BY doc_id, i))"""


@query(
    "top_ngrams_by_class",
    f"""WITH {SQL_TERM}, seq AS (SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3
  FROM term WINDOW s AS (PARTITION BY lang ORDER BY doc_id, i)),
g AS (SELECT lang, 1 AS size, w1 AS ngram FROM seq
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM seq WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM seq WHERE w3 IS NOT NULL),
c AS (SELECT lang, size, ngram, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, size ORDER BY n DESC, ngram) AS rank FROM c)
SELECT lang, size, ngram, n, rank::INTEGER AS rank FROM r WHERE rank <= 20""",
)
def top_ngrams_by_class(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir, "lang"), "tokens")
    return corpus.top_ngrams_by_class(t, "doc_id", "tokens", "lang", [1, 2, 3], 20)


@query(
    "ngrams_cross_doc",
    f"WITH {_SQL_STREAM} SELECT w1, w2, count(*) AS n FROM seq WHERE w2 IS NOT NULL GROUP BY ALL",
)
def ngrams_cross_doc(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir), "tokens")
    return corpus.ngram_counts(t, "doc_id", "tokens", 2)


def _sql_pmi(size: int, stream: str) -> str:
    words = [f"w{i + 1}" for i in range(size)]
    joins = " ".join(f"JOIN u u{i + 1} ON u{i + 1}.w = g.w{i + 1}" for i in range(size))
    product = " * ".join(f"u{i + 1}.c::DOUBLE" for i in range(size))
    return f"""WITH {stream}, u AS (SELECT w, count(*) AS c FROM term GROUP BY w), t AS (SELECT count(*) AS total FROM term),
g AS (SELECT {', '.join(words)}, count(*) AS n FROM seq WHERE w{size} IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT {', '.join('g.' + w for w in words)}, n, round(log2(n * pow(total::DOUBLE, {size - 1}) / ({product})), 6) AS pmi
FROM g {joins}, t ORDER BY pmi DESC, {', '.join('g.' + w for w in words)} LIMIT 50"""


_SQL_INSIDE = _SQL_STREAM.replace("(ORDER BY doc_id, i)", "(PARTITION BY doc_id ORDER BY i)")


@query("pmi_bigrams", _sql_pmi(2, _SQL_STREAM))
def pmi_bigrams(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir), "tokens")
    return corpus.collocations(t, "doc_id", "tokens", 2, k=50)


@query("pmi_trigrams", _sql_pmi(3, _SQL_STREAM))
def pmi_trigrams(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir), "tokens")
    return corpus.collocations(t, "doc_id", "tokens", 3, k=50)


@query("pmi_bigrams_document", _sql_pmi(2, _SQL_INSIDE))
def pmi_bigrams_document(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir), "tokens")
    return corpus.collocations(t, "doc_id", "tokens", 2, k=50, scope="document")


# ---------------------------------------------------------------- co-occurrence

_SQL_EDGES = f"""{SQL_TERM}, near AS (
  SELECT w AS a, lead(w, 1) OVER s AS b1, lead(w, 2) OVER s AS b2 FROM term WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
pair AS (SELECT a, b1 AS b FROM near UNION ALL SELECT a, b2 FROM near),
edge AS MATERIALIZED (SELECT token, context, count(*) AS n FROM (
  SELECT a AS token, b AS context FROM pair WHERE a <> b UNION ALL SELECT b, a FROM pair WHERE a <> b) GROUP BY ALL)"""


@query("cooccurrence", f"WITH {_SQL_EDGES} SELECT * FROM edge")
def cooccurrence(spark, sf_dir):
    return corpus.cooccurrence(tokenized(spark, sf_dir), "tokens", 2)


@query("top_edges", f"WITH {_SQL_EDGES} SELECT * FROM edge ORDER BY n DESC, token, context LIMIT 50")
def top_edges(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir), "tokens")
    return corpus.top_edges(corpus.cooccurrence(t, "tokens", 2, best=50), 50)


@query(
    "top_edges_undirected",
    f"""WITH {_SQL_EDGES}, t AS (SELECT * FROM edge ORDER BY n DESC, token, context LIMIT 50)
SELECT DISTINCT least(token, context) AS a, greatest(token, context) AS b, n FROM t""",
)
def top_edges_undirected(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir), "tokens")
    return corpus.top_edges(corpus.cooccurrence(t, "tokens", 2, best=50), 50, directed=False)


# ---------------------------------------------------------------- TF-IDF

@query(
    "tfidf_overall",
    f"""WITH {SQL_TERM}, tf AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf FROM term WHERE length(w) >= 2 GROUP BY ALL),
n AS (SELECT count(*) AS docs FROM documents), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
x AS (SELECT doc_id, w, tf * (ln((1.0::DOUBLE + docs) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS x FROM tf JOIN df USING (w), n),
y AS (SELECT w, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS y FROM x)
SELECT w AS term, round(sum(y) / any_value(docs), 6) AS score FROM y, n GROUP BY w""",
)
def tfidf_overall(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir), "tokens")
    scores = corpus.tfidf_overall(t, "doc_id", "tokens")
    return scores.withColumn("score", F.round("score", 6))


@query(
    "tfidf_by_class",
    f"""WITH {SQL_TERM}, t0 AS MATERIALIZED (SELECT doc_id, lang, w, count(*) AS tf FROM term WHERE length(w) >= 2 GROUP BY ALL),
tf AS (SELECT lang AS class, doc_id, w, tf FROM t0 UNION ALL SELECT 'all', doc_id, w, tf FROM t0),
n AS (SELECT coalesce(lang, 'all') AS class, count(*) AS docs FROM documents GROUP BY GROUPING SETS ((lang), ())),
df AS (SELECT class, w, count(*) AS df FROM tf GROUP BY ALL),
x AS (SELECT class, doc_id, w, tf * (ln((1.0::DOUBLE + docs) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS x
  FROM tf JOIN df USING (class, w) JOIN n USING (class)),
y AS (SELECT class, w, x / sqrt(sum(x * x) OVER (PARTITION BY class, doc_id)) AS y FROM x),
s AS MATERIALIZED (SELECT class, w, sum(y) / any_value(docs) AS s FROM y JOIN n USING (class) GROUP BY class, w),
v AS (SELECT n.class, a.w AS term, coalesce(s.s, 0) AS score, a.s AS score_all
  FROM (SELECT * FROM s WHERE class = 'all') a CROSS JOIN n LEFT JOIN s ON s.class = n.class AND s.w = a.w),
o AS (SELECT class, term, round(score, 6) AS score, round(score_all, 6) AS score_all, round(score - score_all, 6) + 0.0::DOUBLE AS score_diff FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score_diff DESC, term) AS rank FROM o)
SELECT class, term, score, score_all, score_diff, rank::INTEGER AS rank FROM r WHERE rank <= 20""",
)
def tfidf_by_class(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir, "lang"), "tokens")
    return corpus.tfidf_by_class(t, "doc_id", "tokens", "lang", 20)


@query(
    "vocabulary",
    f"""WITH {SQL_TERM} SELECT w AS term, count(DISTINCT doc_id) AS df FROM term GROUP BY w
HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.5 * (SELECT count(*) FROM documents)""",
)
def vocabulary(spark, sf_dir):
    return corpus.vocabulary(tokenized(spark, sf_dir), "doc_id", "tokens")


# ---------------------------------------------------------------- language detection

_SQL_PROFILE = f"""{SQL_TERM},
word AS MATERIALIZED (SELECT w,
  list_filter(flatten([
    list_transform(range(1, length(w) + 3), lambda i: substr(' ' || w || ' ', i, 1)),
    list_transform(range(1, length(w) + 2), lambda i: substr(' ' || w || ' ', i, 2)),
    list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))]), lambda g: g <> ' ') AS every
  FROM (SELECT DISTINCT w FROM term)),
wg AS MATERIALIZED (SELECT w, gram, count(*) AS k FROM (SELECT w, unnest(every) AS gram FROM word) GROUP BY ALL),
train AS (SELECT lang, w, count(*) AS n FROM term JOIN labels USING (doc_id) GROUP BY ALL),
gn AS MATERIALIZED (SELECT lang, gram, sum(n * k)::BIGINT AS n FROM train JOIN wg USING (w) GROUP BY ALL),
tot AS (SELECT lang, sum(n) AS t, (SELECT count(DISTINCT gram) FROM gn) AS v FROM gn GROUP BY lang),
prof AS MATERIALIZED (SELECT tot.lang, g.gram, coalesce(gn.n, 0)::BIGINT AS n, ln((coalesce(gn.n, 0) + 1.0::DOUBLE) / (t + v)::DOUBLE) AS logp
  FROM (SELECT DISTINCT gram FROM gn) g CROSS JOIN tot LEFT JOIN gn ON gn.gram = g.gram AND gn.lang = tot.lang)"""


@query("language_profiles", f"WITH {_SQL_PROFILE} SELECT lang, gram, n, round(logp, 6) AS logp FROM prof")
def language_profiles(spark, sf_dir):
    profiles = _profiles(spark, sf_dir, tokenized(spark, sf_dir, "lang"))
    return profiles.withColumn("logp", F.round("logp", 6))


def _profiles(spark, sf_dir, tokens):
    """Profiles are trained on the labelled documents."""
    train = stage(labelled(spark, sf_dir, tokens).select("lang", "tokens"), "train")
    return corpus.language_profiles(train, "tokens", "lang")


@query(
    "detected_language",
    f"""WITH {_SQL_PROFILE},
ws AS MATERIALIZED (SELECT w, lang, sum(k * logp) AS s, sum(k) AS g FROM wg JOIN prof USING (gram) GROUP BY ALL),
dt AS (SELECT doc_id, w, count(*) AS tf FROM term GROUP BY ALL),
sc AS (SELECT doc_id, ws.lang, round(sum(s * tf) / sum(g * tf), 9) AS s FROM dt JOIN ws USING (w) GROUP BY ALL),
b AS (SELECT doc_id, lang, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM sc)
SELECT d.doc_id, coalesce(b.lang, 'xxx') AS detected, round(b.s, 6) AS mean_logp
FROM documents d LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (doc_id)""",
)
def detected_language(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir, "lang"), "tokens")
    return corpus.detect_language(t, "doc_id", "tokens", _profiles(spark, sf_dir, t))


# ---------------------------------------------------------------- augmentation

_PICK = sql_number("12345", "lang", "copy")
_DICE = sql_number("12345", "lang", "copy", "i")
SQL_PICKS = f"""size AS (SELECT lang, count(*) AS n, max(count(*)) OVER () - count(*) AS deficit FROM documents GROUP BY lang),
src AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents),
c AS (SELECT lang, n, unnest(range(deficit)) AS copy FROM size),
pick AS (SELECT c.lang, copy, doc_id FROM c JOIN src ON src.lang = c.lang AND src.pos = {_PICK.replace('lang', 'c.lang')} % n)"""


@query(
    "augmented_balanced",
    f"""WITH {_SQL_EDGES},
best AS (SELECT token, context FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, context) AS r FROM edge) WHERE r = 1),
{SQL_PICKS},
wd AS (SELECT p.lang, copy, doc_id, i - 1 AS i, w FROM pick p JOIN term USING (doc_id)),
sw AS (SELECT lang, copy, doc_id, i, CASE WHEN {_DICE} % 100 < 30 THEN coalesce(context, w) ELSE w END AS w FROM wd LEFT JOIN best ON token = w)
SELECT lang, copy, doc_id AS source_id, string_agg(w, ' ' ORDER BY i) AS text, true AS is_new FROM sw GROUP BY ALL
UNION ALL SELECT lang, NULL, doc_id, array_to_string(tokens, ' '), false FROM tok""",
)
def augmented_balanced(spark, sf_dir):
    t = stage(tokenized(spark, sf_dir, "lang"), "tokens")
    neighbours = corpus.top_neighbours(corpus.cooccurrence(t, "tokens", 2))
    return corpus.balanced_corpus(t, "doc_id", "tokens", "lang", neighbours)


@query(
    "augmented_in_context",
    f"""WITH {_SQL_EDGES},
cand AS (SELECT token, context AS c FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, context) AS r FROM edge) WHERE r <= 5),
uni AS MATERIALIZED (SELECT w, count(*) AS n FROM term GROUP BY w),
big AS MATERIALIZED (SELECT a.w AS x, b.w AS y, count(*) AS n FROM term a JOIN term b ON b.doc_id = a.doc_id AND b.i = a.i + 1 GROUP BY ALL),
{SQL_PICKS},
wd AS MATERIALIZED (SELECT doc_id, i - 1 AS i, w, coalesce(lag(w) OVER d, '') AS l, coalesce(lead(w) OVER d, '') AS r FROM term WHERE doc_id IN (SELECT doc_id FROM pick) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
sc AS (SELECT x.l, x.w, x.r, c, CASE WHEN x.l = '' THEN uc.n / (SELECT sum(n) FROM uni)::DOUBLE ELSE coalesce(lb.n / ul.n::DOUBLE, 0.4::DOUBLE * (uc.n / (SELECT sum(n) FROM uni)::DOUBLE)) END
  * CASE WHEN x.r = '' THEN 1.0::DOUBLE ELSE coalesce(rb.n / uc.n::DOUBLE, 0.4::DOUBLE * (ur.n / (SELECT sum(n) FROM uni)::DOUBLE)) END AS s
  FROM (SELECT DISTINCT l, w, r FROM wd) x JOIN cand ON token = x.w JOIN uni uc ON uc.w = c LEFT JOIN uni ul ON ul.w = x.l LEFT JOIN uni ur ON ur.w = x.r
  LEFT JOIN big lb ON lb.x = x.l AND lb.y = c LEFT JOIN big rb ON rb.x = c AND rb.y = x.r),
fit AS (SELECT l, w, r, c FROM (SELECT *, row_number() OVER (PARTITION BY l, w, r ORDER BY s DESC, c) AS k FROM sc) WHERE k = 1),
sw AS (SELECT p.lang, copy, p.doc_id, i, CASE WHEN {_DICE.replace('lang', 'p.lang')} % 100 < 30 THEN coalesce(c, wd.w) ELSE wd.w END AS w
  FROM pick p JOIN wd USING (doc_id) LEFT JOIN fit ON fit.l = wd.l AND fit.w = wd.w AND fit.r = wd.r)
SELECT lang, copy, doc_id AS source_id, string_agg(w, ' ' ORDER BY i) AS text FROM sw GROUP BY ALL""",
)
def augmented_in_context(spark, sf_dir):
    """Copies whose replaced words fit their neighbours, of the five most frequent contexts each."""
    t = stage(tokenized(spark, sf_dir, "lang"), "tokens")
    candidates = corpus.closest_neighbours(corpus.cooccurrence(t, "tokens", 2), 5)
    return corpus.augment_in_context(t, "doc_id", "tokens", "lang", candidates)
