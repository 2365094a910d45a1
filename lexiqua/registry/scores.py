"""Evaluation of two deterministic scorers: letter shares per language and text length versus quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import evaluation as E
from ..plans.staging import stage
from .base import documents, query, table

CLASSES = ["de", "en", "es", "fr"]
MARKS = {"de": "ü", "en": "th", "es": "ó", "fr": "é"}

_SQL_LANG = "s AS MATERIALIZED (SELECT doc_id, lang AS y, [" + ", ".join(
    f"round((length(text) - length(replace(text, '{m}', ''))) / length(text)::DOUBLE, 9)" for m in MARKS.values()
) + """] AS scores FROM documents),
p AS MATERIALIZED (SELECT doc_id, y, scores, ['de', 'en', 'es', 'fr'][list_position(scores, list_max(scores))] AS p FROM s)"""


def language_scores(spark, sf_dir):
    """(doc_id, y, scores, p): share of each language's marker letters; the largest share wins.

    An empty text has shares of NaN, 0/0 in the SQL, and so the first class.
    """
    d = documents(spark, sf_dir)
    size = F.length("text")
    shares = [
        F.when(size == 0, F.lit(float("nan"))).otherwise(F.round((size - F.length(F.replace("text", F.lit(m)))) / size, 9)) for m in MARKS.values()
    ]
    s = d.select("doc_id", F.col("lang").alias("y"), F.array(*shares).alias("scores"))
    return s.withColumn("p", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), N.argmax(F.col("scores")) + 1))


_SQL_QUALITY = """q AS MATERIALIZED (SELECT doc_id, quality AS y, n_chars::DOUBLE AS score, (n_chars >= 1000)::INTEGER AS p,
  CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id))"""


def quality_scores(spark, sf_dir):
    """(doc_id, y, score, p, split): text length as a score for quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        "doc_id",
        F.col("quality").alias("y"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") >= 1000).cast("int").alias("p"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


# ---------------------------------------------------------------- confusion matrix and metrics

@query(
    "confusion_matrix",
    f"""WITH {_SQL_LANG}, l AS (SELECT y AS l FROM p UNION SELECT p FROM p), n AS (SELECT y, p, count(*) AS n FROM p GROUP BY ALL)
SELECT a.l AS truth, b.l AS prediction, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN n ON n.y = a.l AND n.p = b.l""",
)
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(language_scores(spark, sf_dir), "y", "p")


def _sql_metrics(source: str, group: str = "", truth: str = "y", prediction: str = "p") -> str:
    """Metric rows of a table, optionally per group column."""
    g = f"{group}, " if group else ""
    using = f"USING ({group})" if group else "ON true"
    return f"""(WITH lab AS (SELECT DISTINCT {g}unnest([{truth}, {prediction}]) AS c FROM {source}),
cc AS (SELECT {', '.join(f'lab.{x}' for x in [group] if x)}{', ' if group else ''}c,
  count(*) FILTER ({truth} = c AND {prediction} = c) AS tp, count(*) FILTER ({truth} <> c AND {prediction} = c) AS fp,
  count(*) FILTER ({truth} = c AND {prediction} <> c) AS fn FROM lab JOIN {source} {using} GROUP BY ALL),
m AS (SELECT *, tp + fn AS sup, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cc),
a AS (SELECT {g}sum(tp) / sum(sup) AS acc, sum(tp) / (sum(tp) + sum(fp)) AS prec, avg(f1) AS f1m, avg(pr) AS prm, avg(re) AS rem,
  sum(f1 * sup) / sum(sup) AS f1w, sum(pr * sup) / sum(sup) AS prw, sum(re * sup) / sum(sup) AS rew,
  2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1i FROM m GROUP BY ALL)
SELECT {g}unnest(['accuracy', 'f1_macro', 'f1_micro', 'f1_weighted', 'precision_macro', 'precision_micro', 'precision_weighted',
  'recall_macro', 'recall_micro', 'recall_weighted']) AS metric, unnest([acc, f1m, f1i, f1w, prm, prec, prw, rem, acc, rew]) AS value FROM a)"""


@query("classification_metrics", f"WITH {_SQL_LANG} SELECT metric, round(value, 6) AS value FROM {_sql_metrics('p')}")
def classification_metrics(spark, sf_dir):
    m = E.classification_metrics(language_scores(spark, sf_dir), "y", "p")
    return m.withColumn("value", F.round("value", 6))


@query("metrics_by_split", f"WITH {_SQL_QUALITY} SELECT split, metric, round(value, 6) AS value FROM {_sql_metrics('q', 'split')}")
def metrics_by_split(spark, sf_dir):
    m = E.classification_metrics(quality_scores(spark, sf_dir), "y", "p", ["split"])
    return m.withColumn("value", F.round("value", 6))


@query(
    "binary_metrics",
    f"""WITH {_SQL_QUALITY}, c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp,
  count(*) FILTER (y = 1 AND p <> 1) AS fn, count(*) FILTER (y = p) AS hit FROM q)
SELECT n AS rows, round(hit / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall FROM c""",
)
def binary_metrics(spark, sf_dir):
    m = E.binary_metrics(quality_scores(spark, sf_dir), "y", "p", 1)
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1", "precision", "recall")})


# ---------------------------------------------------------------- sweeps

_SQL_OVR = f"""{_SQL_LANG}, o AS (SELECT c AS class, (y = c)::INTEGER AS y, s AS score
  FROM (SELECT y, unnest(['de', 'en', 'es', 'fr']) AS c, unnest(scores) AS s FROM p))"""
_SQL_SWEEP = """sw AS MATERIALIZED (SELECT class, score, sum(pp) OVER w AS tp, sum(nn) OVER w AS fp, sum(pp) OVER (PARTITION BY class) AS pos,
  sum(nn) OVER (PARTITION BY class) AS neg FROM (SELECT class, score, sum(y) AS pp, sum(1 - y) AS nn FROM o GROUP BY ALL)
  WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""
_SQL_ROC = """roc AS MATERIALIZED (SELECT class, score AS threshold, fp / neg AS fpr, tp / pos AS tpr FROM sw
  UNION ALL SELECT DISTINCT class, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM sw)"""
_SQL_AUC = """area AS (SELECT class, sum((fpr - px) * (tpr + py) / 2) AS auc FROM (SELECT class, fpr, tpr,
  lag(fpr) OVER w AS px, lag(tpr) OVER w AS py FROM roc WINDOW w AS (PARTITION BY class ORDER BY fpr, tpr)) WHERE px IS NOT NULL GROUP BY class)"""


def _swept(spark, sf_dir):
    return E.sweep(E.one_vs_rest(language_scores(spark, sf_dir), "y", "scores", CLASSES), ["class"])


@query(
    "roc_points",
    f"WITH {_SQL_OVR}, {_SQL_SWEEP}, {_SQL_ROC} SELECT class, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc",
)
def roc_points(spark, sf_dir):
    return E.roc_points(_swept(spark, sf_dir), ["class"]).withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query("auc_by_class", f"WITH {_SQL_OVR}, {_SQL_SWEEP}, {_SQL_ROC}, {_SQL_AUC} SELECT class, round(auc, 6) AS auc FROM area")
def auc_by_class(spark, sf_dir):
    return E.auc(_swept(spark, sf_dir), ["class"]).withColumn("auc", F.round("auc", 6))


_SQL_BEST = """best AS (SELECT class, score AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, score {tie}) AS r
  FROM (SELECT class, score, round(2 * tp / (tp + fp + pos), 12) AS f1 FROM sw)) WHERE r = 1)"""


@query(
    "best_f1_threshold",
    f"WITH {_SQL_OVR}, {_SQL_SWEEP}, {_SQL_BEST.format(tie='DESC')} SELECT class, threshold, round(f1, 6) AS f1 FROM best",
)
def best_f1_threshold(spark, sf_dir):
    return E.best_f1_threshold(_swept(spark, sf_dir), ["class"]).withColumn("f1", F.round("f1", 6))


_SQL_QO = f"{_SQL_QUALITY}, o AS (SELECT split AS class, y, score FROM q)"


def _quality_sweep(spark, sf_dir):
    q = quality_scores(spark, sf_dir).select(F.col("split").alias("class"), F.col("y").cast("long").alias("y"), "score")
    return E.sweep(q, ["class"])


@query(
    "pr_curve",
    f"""WITH {_SQL_QO}, {_SQL_SWEEP} SELECT class, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM sw
UNION ALL SELECT DISTINCT class, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM sw""",
)
def pr_curve(spark, sf_dir):
    return E.pr_curve(_quality_sweep(spark, sf_dir), ["class"]).withColumns(
        {c: F.round(c, 6) for c in ("precision", "recall")}
    )


@query(
    "best_pr_threshold",
    f"WITH {_SQL_QO}, {_SQL_SWEEP}, {_SQL_BEST.format(tie='ASC')} SELECT class, threshold, round(f1, 6) AS f1 FROM best",
)
def best_pr_threshold(spark, sf_dir):
    best = E.best_f1_threshold(_quality_sweep(spark, sf_dir), ["class"], ties="lowest")
    return best.withColumn("f1", F.round("f1", 6))


@query(
    "weighted_eval",
    f"""WITH {_SQL_OVR}, {_SQL_SWEEP}, {_SQL_ROC}, {_SQL_AUC}, w AS (SELECT class, max(pos) AS w FROM sw GROUP BY class)
SELECT metric, round(value, 6) AS value FROM {_sql_metrics('p')} WHERE metric IN ('accuracy', 'f1_weighted', 'precision_weighted', 'recall_weighted')
UNION ALL SELECT 'roc_auc', round(sum(auc * w) / sum(w), 6) FROM area JOIN w USING (class)""",
)
def weighted_eval(spark, sf_dir):
    s = stage(language_scores(spark, sf_dir), "scores")
    return E.weighted_eval(s, "y", "p", "scores", CLASSES).withColumn("value", F.round("value", 6))


@query(
    "log_loss_accuracy",
    f"""WITH {_SQL_LANG}, t AS (SELECT y, p, doc_id % 5 AS part, (scores[list_position(['de', 'en', 'es', 'fr'], y)] + 0.01::DOUBLE) / (list_sum(scores) + 0.04::DOUBLE) AS py FROM p)
SELECT part, count(*) AS rows, round(avg((y = p)::INTEGER), 6) AS accuracy, round(avg(-ln(py)), 6) AS log_loss FROM t GROUP BY part""",
)
def log_loss_accuracy(spark, sf_dir):
    s = language_scores(spark, sf_dir).withColumn("part", F.col("doc_id") % 5)
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("y")).cast("int")
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    p_y = (F.element_at("scores", place) + 0.01) / (total + 0.04)
    m = E.log_loss_accuracy(s, "y", "p", p_y, ["part"])
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "log_loss")})


@query(
    "model_leaderboard",
    f"""WITH {_SQL_LANG}, k AS (SELECT y, p, 'en' AS always, doc_id IN (SELECT doc_id FROM labels) AS held FROM p),
ka AS (SELECT y, p FROM k), kb AS (SELECT y, always AS p FROM k), kc AS (SELECT y, p FROM k WHERE held), kd AS (SELECT y, always AS p FROM k WHERE held),
t AS (SELECT 'all' AS dataset, 'letters' AS model, * FROM {_sql_metrics('ka')} UNION ALL SELECT 'all', 'majority', * FROM {_sql_metrics('kb')}
  UNION ALL SELECT 'labelled', 'letters', * FROM {_sql_metrics('kc')} UNION ALL SELECT 'labelled', 'majority', * FROM {_sql_metrics('kd')})
SELECT dataset, model, metric, round(value, 6) AS value, rank() OVER (PARTITION BY dataset, metric ORDER BY round(value, 9) DESC)::INTEGER AS rank FROM t""",
)
def model_leaderboard(spark, sf_dir):
    s = stage(language_scores(spark, sf_dir).select("doc_id", "y", "p", F.lit("en").alias("always")), "scores")
    held = s.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    tables = [
        (name, model, E.classification_metrics(rows, "y", column))
        for name, rows in (("all", s), ("labelled", held))
        for model, column in (("letters", "p"), ("majority", "always"))
    ]
    return E.leaderboard(tables).withColumn("value", F.round("value", 6))


@query(
    "thresholded_predictions",
    f"""WITH {_SQL_OVR}, {_SQL_SWEEP}, {_SQL_BEST.format(tie='DESC')}, t AS (SELECT list(threshold ORDER BY class) AS t FROM best)
SELECT doc_id, coalesce(CASE WHEN scores[4] >= t[4] THEN 3 WHEN scores[3] >= t[3] THEN 2 WHEN scores[2] >= t[2] THEN 1 WHEN scores[1] >= t[1] THEN 0 END, 0) AS predicted FROM p, t""",
)
def thresholded_predictions(spark, sf_dir):
    s = stage(language_scores(spark, sf_dir), "scores")
    swept = E.sweep(E.one_vs_rest(s, "y", "scores", CLASSES), ["class"])
    found = {r["class"]: r["threshold"] for r in E.best_f1_threshold(swept, ["class"]).collect()}
    return s.select("doc_id", N.predict_with_thresholds(F.col("scores"), [found[c] for c in CLASSES]).alias("predicted"))
