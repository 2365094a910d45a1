"""Feature columns, profiles, joins and outliers on the relational tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import features, profile
from ..plans.neighbours import nearest_in_group
from ..plans.staging import spread
from .base import query, table

# ---------------------------------------------------------------- vectors and scores

_SQL_LOGITS = "list_transform(embedding, lambda x: x::DOUBLE)"


def _sql_softmax(values: str) -> str:
    shifted = f"list_transform({values}, lambda x: exp(x - list_max({values})))"
    return f"list_transform({shifted}, lambda x: x / list_sum({shifted}))"


@query(
    "softmax_argmax",
    f"""WITH l AS (SELECT vec_id, {_SQL_LOGITS} AS l FROM embeddings), p AS (SELECT vec_id, l, {_sql_softmax('l')} AS p FROM l)
SELECT vec_id, (list_position(l, list_max(l)) - 1)::INTEGER AS predicted, round(list_max(p), 6) AS top_prob, round(list_sum(p), 6) AS total FROM p""",
)
def softmax_argmax(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("l")
    ).withColumn("p", N.softmax(F.col("l")))
    return p.select(
        "vec_id",
        N.argmax(F.col("l")).alias("predicted"),
        F.round(F.array_max("p"), 6).alias("top_prob"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


# three class scores from sums over the whole vector: entries 1-21, 22-42 and 43 to the end
_SQL_SENTIMENT = f"""vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
l AS (SELECT vec_id, label, [list_sum(v[1:21]) * 2, list_sum(v[22:42]) * 2, list_sum(v[43:]) * 2] AS l FROM vectors),
s AS (SELECT vec_id, label, p[3] - p[1] AS score FROM (SELECT vec_id, label, {_sql_softmax('l')} AS p FROM l))"""


def sentiment(spark, sf_dir):
    """(vec_id, label, score): class probabilities from three sums over the whole vector."""

    def total(start: int, length: int | Column) -> Column:
        return F.aggregate(F.slice("embedding", start, length), F.lit(0.0), lambda a, x: a + x.cast("double")) * 2

    logits = F.array(total(1, 21), total(22, 21), total(43, F.greatest(F.size("embedding") - 42, F.lit(0))))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", N.softmax(logits).alias("p"))
    return e.select("vec_id", "label", N.sentiment_score(F.col("p")).alias("score"))


@query("sentiment_score", f"WITH {_SQL_SENTIMENT} SELECT vec_id, round(score, 6) AS score FROM s")
def sentiment_score(spark, sf_dir):
    return sentiment(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "sentiment_polarity",
    f"""WITH {_SQL_SENTIMENT} SELECT vec_id, CASE WHEN score < -0.33::DOUBLE THEN 'negative' WHEN score > 0.33::DOUBLE THEN 'positive'
  ELSE 'neutral' END AS polarity FROM s""",
)
def sentiment_polarity(spark, sf_dir):
    return sentiment(spark, sf_dir).select("vec_id", N.polarity(F.col("score")).alias("polarity"))


@query(
    "score_histogram",
    f"""WITH {_SQL_SENTIMENT}, x AS (SELECT label::VARCHAR AS class, round(score, 6) AS x FROM s UNION ALL SELECT 'all', round(score, 6) FROM s),
e AS (SELECT class, min(x) AS lo, max(x) AS hi FROM x GROUP BY class)
SELECT class, least(floor((x - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, lo, hi, count(*) AS n FROM x JOIN e USING (class) GROUP BY ALL""",
)
def score_histogram(spark, sf_dir):
    s = sentiment(spark, sf_dir).withColumn("score", F.round("score", 6))
    return profile.score_histogram(s, "label", "score", 20)


@query(
    "embedding_columns",
    "SELECT vec_id, label, " + ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS col_embedding_{i}" for i in range(1, 65)) + " FROM embeddings",
)
def embedding_columns(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    )
    return features.embedding_columns(e, "embedding")


# Words of the part names (the oracle names its columns).
PART_WORDS = (
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large",
    "new", "old", "plate", "red", "ring", "rod", "small", "widget",
)


@query(
    "multi_hot",
    "SELECT p_partkey, " + ", ".join(f"list_contains(string_split(p_name, ' '), '{w}')::INTEGER AS word_{w}" for w in PART_WORDS) + " FROM part",
)
def multi_hot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return features.multi_hot(p, "words", "word")


@query("multi_hot_long", "SELECT doc_id, w AS value FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def multi_hot_long(spark, sf_dir):
    """Far more values than a table has columns."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split("text", " "), "").alias("words"))
    return features.multi_hot_long(d, "doc_id", "words")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "standard_scaled",
    "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_NUMBERS) + " FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 5) + 0.0::DOUBLE AS {c}" for c in LINE_NUMBERS) + " FROM lineitem, s",
)
def standard_scaled(spark, sf_dir):
    li = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", *LINE_NUMBERS)
    scaled = features.standard_scaled(li, LINE_NUMBERS)
    return scaled.withColumns({c: F.round(c, 5) for c in LINE_NUMBERS})


@query(
    "label_binarized",
    """SELECT o_orderkey, c.class, (o_orderstatus = c.class)::INTEGER AS is_class
FROM orders CROSS JOIN (VALUES ('F'), ('O'), ('P')) AS c(class)""",
)
def label_binarized(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders")).select("o_orderkey", "o_orderstatus")
    return features.binarized(o, "o_orderstatus", ["F", "O", "P"]).drop("o_orderstatus")


# ---------------------------------------------------------------- importance, neighbours

PART_ORIGINALS = ["p_type", "p_brand", "p_brand_Brand#1", "p_size", "p_container"]


@query(
    "importance_rollup",
    """WITH f AS (
  SELECT 'a' AS model, 'p_type_' || p_type AS feature, sum(p_retailprice) / 1000000 AS importance FROM part GROUP BY p_type
  UNION ALL SELECT 'a', 'p_brand_' || p_brand, sum(p_size) / 100000.0::DOUBLE FROM part GROUP BY p_brand
  UNION ALL SELECT 'b', 'p_type_' || p_type, count(*) / 1000.0::DOUBLE FROM part GROUP BY p_type
  UNION ALL SELECT 'b', 'p_size', avg(p_size) FROM part),
o(name) AS (VALUES ('p_type'), ('p_brand'), ('p_brand_Brand#1'), ('p_size'), ('p_container')),
m AS (SELECT DISTINCT model FROM f)
SELECT m.model, o.name AS feature, round(coalesce(sum(importance), 0), 6) AS total, round(avg(importance), 6) AS average
FROM m CROSS JOIN o LEFT JOIN f ON f.model = m.model AND contains(f.feature, o.name) GROUP BY ALL""",
)
def importance_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "part")

    def encoded(model, group, prefix, value):
        name = F.concat(F.lit(prefix), *([F.lit("_"), F.col(group)] if group else []))
        return (p.groupBy(group) if group else p.groupBy()).agg(value.alias("importance")).select(
            F.lit(model).alias("model"), name.alias("feature"), "importance"
        )

    importance = (
        encoded("a", "p_type", "p_type", F.sum("p_retailprice") / 1000000)
        .unionByName(encoded("a", "p_brand", "p_brand", F.sum("p_size") / 100000))
        .unionByName(encoded("b", "p_type", "p_type", F.count(F.lit(1)) / 1000))
        .unionByName(encoded("b", None, "p_size", F.avg("p_size")))
    )
    total = features.importance_rollup(importance, PART_ORIGINALS, "sum")
    average = features.importance_rollup(importance, PART_ORIGINALS, "average")
    return total.withColumnRenamed("importance", "total").join(
        average.withColumnRenamed("importance", "average"), ["model", "feature"]
    ).withColumns({c: F.round(c, 6) for c in ("total", "average")})


SQL_NEAR = """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour_id, round(list_distance(a.v, b.v), 9) AS distance
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY distance, neighbour_id) AS rank FROM d) WHERE rank <= 5)"""


@query(
    "knn_within_class",
    f"WITH {SQL_NEAR} SELECT label, vec_id, neighbour_id, distance, rank::INTEGER AS rank FROM near",
)
def knn_within_class(spark, sf_dir):
    e = spread(table(spark, sf_dir, "embeddings"))
    return nearest_in_group(e, e, "label", "vec_id", "embedding", 5)


@query(
    "knn_hashed_recall",
    f"""WITH {SQL_NEAR} SELECT label, count(DISTINCT vec_id) AS vectors, count(*) AS neighbours, true AS recall_of_nine_tenths FROM near GROUP BY label""",
)
def knn_hashed_recall(spark, sf_dir):
    """Of the exact neighbours' places, how many the hashed search fills as near, per class."""
    e = spread(table(spark, sf_dir, "embeddings"))
    exact, hashed = (nearest_in_group(e, e, "label", "vec_id", "embedding", 5, method=m) for m in ("exact", "lsh"))
    found = hashed.select("vec_id", "rank", F.col("distance").alias("hashed"))
    joined = exact.join(found, ["vec_id", "rank"], "left")
    return joined.groupBy("label").agg(
        F.countDistinct("vec_id").alias("vectors"), F.count(F.lit(1)).alias("neighbours"),
        (F.avg(F.coalesce((F.col("hashed") == F.col("distance")).cast("int"), F.lit(0))) >= 0.9).alias("recall_of_nine_tenths"),
    )


# ---------------------------------------------------------------- counts and distributions

@query(
    "category_distribution",
    """WITH c AS (SELECT DISTINCT c_nationkey AS category FROM customer),
k AS (SELECT DISTINCT c_mktsegment AS class FROM customer UNION ALL SELECT 'all'),
n AS (SELECT c_nationkey AS category, coalesce(c_mktsegment, 'all') AS class, count(*) AS n FROM customer
  GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey)))
SELECT category, class, coalesce(n, 0) AS n FROM c CROSS JOIN k LEFT JOIN n USING (category, class)""",
)
def category_distribution(spark, sf_dir):
    return profile.category_distribution(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query(
    "distribution_by_category",
    """WITH e AS (SELECT event_type AS category, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
b AS (SELECT category, 'bin' AS kind, least(floor((value - lo) / (hi - lo) * 10), 9)::INTEGER::VARCHAR AS key, count(*)::DOUBLE AS value
  FROM events JOIN e ON event_type = category GROUP BY ALL),
q AS (SELECT event_type AS category, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM events GROUP BY 1),
u AS (SELECT category, 'quantile' AS kind, unnest(['p00', 'p25', 'p50', 'p75', 'p100']) AS key, unnest(q) AS value FROM q)
SELECT category, kind, key, round(value, 6) AS value FROM (SELECT * FROM b UNION ALL SELECT * FROM u)""",
)
def distribution_by_category(spark, sf_dir):
    d = profile.distribution_by_category(spread(table(spark, sf_dir, "events")), "value", "event_type", 10)
    return d.withColumn("value", F.round("value", 6))


@query(
    "density_by_category",
    """WITH s AS (SELECT event_type AS category, count(*) AS n, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi,
  (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34::DOUBLE AS iqr FROM events WHERE value IS NOT NULL GROUP BY 1),
h AS (SELECT *, 0.9::DOUBLE * CASE WHEN iqr > 0 THEN least(s, iqr) ELSE s END * pow(n, -0.2::DOUBLE) AS h FROM s),
g AS (SELECT category, n, h, lo - 2 * h AS a, (hi - lo + 4 * h) / 99 AS step FROM h WHERE h > 0),
p AS (SELECT g.*, (value - a) / step AS place FROM events JOIN g ON category = event_type),
b AS (SELECT *, least(floor(place), 98)::INTEGER AS bin FROM p),
w AS (SELECT category, bin, sum(w) AS w FROM (SELECT category, bin, 1 - (place - bin) AS w FROM b UNION ALL SELECT category, bin + 1, place - bin FROM b) GROUP BY ALL)
SELECT category, point::INTEGER AS point, round(a + point * step, 6) AS x,
  round(sum(w * exp(-0.5 * pow((point - bin) * step / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g CROSS JOIN range(100) r(point) JOIN w USING (category) GROUP BY category, point, a, step, n, h""",
)
def density_by_category(spark, sf_dir):
    d = profile.density_by_category(spread(table(spark, sf_dir, "events")), "value", "event_type", 100)
    return d.withColumns({c: F.round(c, 6) for c in ("x", "density")})


@query(
    "column_profile",
    """WITH o AS (SELECT o_orderstatus, o_orderpriority, o_totalprice, o_orderkey % 7 AS weekday, o_custkey FROM orders),
m AS (SELECT o_orderstatus AS class, unnest(['o_totalprice', 'o_custkey']) AS "column", unnest([o_totalprice, o_custkey::DOUBLE]) AS x FROM o),
e AS (SELECT "column", class, min(x) AS lo, max(x) AS hi FROM m GROUP BY ALL)
SELECT 'o_orderstatus' AS "column", 'target' AS kind, o_orderstatus AS bucket, o_orderstatus AS class, count(*) AS n FROM o GROUP BY ALL
UNION ALL SELECT 'weekday', 'cross', weekday::VARCHAR, o_orderstatus, count(*) FROM o GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', 'cross', o_orderpriority, o_orderstatus, count(*) FROM o GROUP BY ALL
UNION ALL SELECT "column", 'histogram', least(floor((x - lo) / (hi - lo) * 10), 9)::INTEGER::VARCHAR, class, count(*)
  FROM m JOIN e USING ("column", class) GROUP BY ALL""",
)
def column_profile(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders")).withColumn("weekday", F.col("o_orderkey") % 7)
    return profile.column_profile(
        o.select("o_orderstatus", "o_orderpriority", "o_totalprice", "weekday", "o_custkey"), "o_orderstatus"
    )


@query(
    "crosstab",
    "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1",
)
def crosstab(spark, sf_dir):
    return profile.crosstab(spread(table(spark, sf_dir, "lineitem")), "l_returnflag", "l_linestatus")


@query(
    "correlation_pairs",
    " UNION ALL ".join(
        f"SELECT '{b}' AS row_feature, '{a}' AS col_feature, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for a, b in combinations(LINE_NUMBERS, 2)
    ),
)
def correlation_pairs(spark, sf_dir):
    c = profile.correlation_pairs(spread(table(spark, sf_dir, "lineitem")), LINE_NUMBERS)
    return c.withColumn("corr", F.round("corr", 6))


@query(
    "boxplot_stats",
    """WITH m AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
  unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem
  UNION ALL SELECT 'value', value FROM events),
q AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM m GROUP BY 1),
f AS (SELECT m.feature, x, q1, median, q3, x >= q1 - (q3 - q1) * 1.5 AND x <= q3 + (q3 - q1) * 1.5 AS inside FROM m JOIN q USING (feature))
SELECT feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(x) FILTER (inside) AS whisker_low,
  max(x) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY ALL""",
)
def boxplot_stats(spark, sf_dir):
    lines = profile.boxplot_stats(spread(table(spark, sf_dir, "lineitem")), LINE_NUMBERS)
    values = profile.boxplot_stats(spread(table(spark, sf_dir, "events")), ["value"])
    return lines.unionByName(values).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


def _sql_bin(x: str, lo: str, hi: str) -> str:
    return f"least(floor(({x} - {lo}) / ({hi} - {lo}) * 10), 9)::INTEGER"


@query(
    "pairwise_bins",
    "WITH r AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE_NUMBERS) + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x_feature, '{b}' AS y_feature, {_sql_bin(a, 'lo_' + a, 'hi_' + a)} AS x_bin, "
        f"{_sql_bin(b, 'lo_' + b, 'hi_' + b)} AS y_bin, count(*) AS n FROM lineitem, r GROUP BY ALL"
        for a, b in combinations(LINE_NUMBERS, 2)
    ),
)
def pairwise_bins(spark, sf_dir):
    return profile.pairwise_bins(spread(table(spark, sf_dir, "lineitem")), LINE_NUMBERS, 10)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "status_label_shares",
    """WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS target,
  CASE WHEN o_totalprice < 100000 THEN '5-LOW' WHEN o_totalprice < 250000 THEN '3-MEDIUM' ELSE '1-URGENT' END AS prediction FROM orders),
s(status) AS (VALUES ('F'), ('O'), ('P'), ('X')), l(label) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')),
n AS (SELECT status, count(*) AS n FROM o GROUP BY 1)
SELECT s.status, 'target' AS source, l.label, round(count(o.status) / any_value(n.n) * 100, 1) AS percent
  FROM s CROSS JOIN l LEFT JOIN n USING (status) LEFT JOIN o ON o.status = s.status AND o.target = l.label GROUP BY ALL
UNION ALL SELECT s.status, 'prediction', l.label, round(count(o.status) / any_value(n.n) * 100, 1)
  FROM s CROSS JOIN l LEFT JOIN n USING (status) LEFT JOIN o ON o.status = s.status AND o.prediction = l.label GROUP BY ALL""",
)
def status_label_shares(spark, sf_dir):
    price = F.col("o_totalprice")
    o = spread(table(spark, sf_dir, "orders")).withColumn(
        "prediction", F.when(price < 100000, "5-LOW").when(price < 250000, "3-MEDIUM").otherwise("1-URGENT")
    )
    return profile.status_label_shares(o, "o_orderstatus", "o_orderpriority", "prediction", ["F", "O", "P", "X"], PRIORITIES)


@query(
    "class_deficits",
    "SELECT lang, count(*) AS n, max(count(*)) OVER () - count(*) AS deficit FROM documents GROUP BY lang",
)
def class_deficits(spark, sf_dir):
    return profile.class_deficits(table(spark, sf_dir, "documents"), "lang")


@query(
    "union_tagged",
    """SELECT 'customer' AS kind, c_nationkey AS nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance, NULL::DOUBLE AS largest FROM customer GROUP BY ALL
UNION ALL SELECT 'supplier', s_nationkey, count(*), round(sum(s_acctbal), 2), max(s_acctbal) FROM supplier GROUP BY ALL""",
)
def union_tagged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nationkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )
    s = table(spark, sf_dir, "supplier").groupBy(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nationkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.max("s_acctbal").alias("largest")
    )
    return c.unionByName(s, allowMissingColumns=True)


# ---------------------------------------------------------------- outliers

def _event_numbers(spark, sf_dir):
    return spread(table(spark, sf_dir, "events")).select(
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "error").alias("keep"),
    )


def _sql_outliers(mode: str, keep: bool) -> str:
    kept = " OR keep" if keep else ""
    test = "{c} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5"
    q = "SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}"
    second = "e" if mode == "independent" else "e1"
    return f"""e AS (SELECT event_id, value, json_extract(props, '$.k')::DOUBLE AS k, event_type = 'error' AS keep FROM events),
qv AS ({q.format(c='value', t='e')}), e1 AS (SELECT e.* FROM e, qv WHERE {test.format(c='value')}{kept}),
qk AS ({q.format(c='k', t=second)}), e2 AS (SELECT e1.* FROM e1, qk WHERE {test.format(c='k')}{kept})"""


@query("iqr_filtered", f"WITH {_sql_outliers('sequential', True)} SELECT event_id, value, k FROM e2")
def iqr_filtered(spark, sf_dir):
    kept, _ = profile.remove_outliers(_event_numbers(spark, sf_dir), ["value", "k"], keep_col="keep")
    return kept.select("event_id", "value", "k")


@query("iqr_filtered_independent", f"WITH {_sql_outliers('independent', False)} SELECT event_id, value, k FROM e2")
def iqr_filtered_independent(spark, sf_dir):
    kept, _ = profile.remove_outliers(_event_numbers(spark, sf_dir), ["value", "k"], mode="independent")
    return kept.select("event_id", "value", "k")


@query(
    "iqr_removed_counts",
    f"""WITH {_sql_outliers('sequential', False)}, c AS (SELECT (SELECT count(*) FROM e) AS a, (SELECT count(*) FROM e1) AS b, (SELECT count(*) FROM e2) AS d)
SELECT 1 AS step, 'value' AS "column", a - b AS removed FROM c UNION ALL SELECT 2, 'k', b - d FROM c""",
)
def iqr_removed_counts(spark, sf_dir):
    _, removed = profile.remove_outliers(_event_numbers(spark, sf_dir), ["value", "k"])
    return removed
