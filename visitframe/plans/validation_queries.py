"""Orchestrated validation, utility and streaming replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import stats, validation
from visitframe.plans.base import ORDER_VISITS_SQL, halves, order_visits, query, rounded, t
from visitframe.plans.matching_queries import FEATURES, vectors
from visitframe.session import materialize
from visitframe.streaming import visits as streaming


def _sides(spark, sf):
    v = order_visits(spark, sf).withColumn("month", F.month("visit").cast("double"))
    return halves(v.where("price is not null and score is not null and month is not null"), "row_id")


_SIDES_SQL = f"SELECT *, month(visit)::DOUBLE AS month, row_id % 2 = 0 AS is_real FROM ({ORDER_VISITS_SQL}) WHERE price IS NOT NULL AND score IS NOT NULL AND visit IS NOT NULL"
_AGE_MATCHED_SQL = f"""SELECT v.* FROM ({_SIDES_SQL}) v, (SELECT min(month) AS lo, max(month) AS hi FROM ({_SIDES_SQL}) WHERE is_real AND month < 7)
    WHERE CASE WHEN is_real THEN month < 7 ELSE month BETWEEN lo - 0.05 * (hi - lo) AND hi + 0.05 * (hi - lo) END"""


def _fidelity_sql(numeric: list[str], categorical: list[str], sides: str = _SIDES_SQL) -> str:
    """Tests of fidelity over the columns of `sides`, a select with is_real. P-values of chi-square are those of two and four degrees, which have closed forms;
    the correlation of a single pair is undefined, so that its test doesn't count."""
    each = lambda names, select: " UNION ALL ".join(select(c) for c in names)
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    return f"""o AS ({sides}),
    n AS (SELECT count(*) FILTER (is_real)::DOUBLE AS r, count(*) FILTER (NOT is_real)::DOUBLE AS s FROM o),
    l AS ({each(numeric, lambda c: f"SELECT '{c}' AS variable, {c} AS v, is_real::INT AS a FROM o")}),
    c AS (SELECT variable, sum(sum(a)) OVER w AS a, sum(sum(1 - a)) OVER w AS b FROM l GROUP BY variable, v WINDOW w AS (PARTITION BY variable ORDER BY v)),
    d AS (SELECT variable, sqrt(r * s / (r + s)) AS en, max(abs(a / r - b / s)) AS gap FROM c, n GROUP BY variable, r, s),
    x AS (SELECT variable, (en + 0.12 + 0.11 / en) * gap AS x FROM d),
    ks AS (SELECT variable, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * x * x)))) END::DOUBLE AS p FROM x, range(1, 101) t(k) GROUP BY variable, x),
    k AS ({each(categorical, lambda c: f"SELECT '{c}' AS variable, count(*) FILTER (is_real) AS a, count(*) FILTER (NOT is_real) AS b FROM o GROUP BY {c}") or "SELECT NULL AS variable, 0 AS a, 0 AS b WHERE false"}),
    h AS (SELECT variable, sum((b - a * s / r) ** 2 / (a * s / r)) AS x, count(*) - 1 AS degrees FROM k, n GROUP BY variable),
    g AS ({each(pairs, lambda p: f"SELECT corr({p[0]}, {p[1]}) FILTER (is_real) AS x, corr({p[0]}, {p[1]}) FILTER (NOT is_real) AS y FROM o")}),
    m AS (SELECT sum(abs(x - y)) * 2 / {len(numeric) ** 2} AS mad, nullif(corr(x, y), 'nan'::DOUBLE) AS meta FROM g),
    fidelity AS (SELECT 'ks' AS test, variable, 'p_value' AS metric, p AS value, 0.05::DOUBLE AS threshold, p > 0.05 AS passed FROM ks
      UNION ALL SELECT 'chi_square', variable, 'p_value', p, 0.05, p > 0.05 FROM (SELECT variable, CASE degrees WHEN 2 THEN exp(-x / 2) WHEN 4 THEN exp(-x / 2) * (1 + x / 2) END AS p FROM h)
      UNION ALL SELECT 'correlation', NULL, 'mad', mad, 0.15, mad < 0.15 FROM m UNION ALL SELECT 'correlation', NULL, 'meta_correlation', meta, 0.8, meta > 0.8 FROM m)"""


@query(f"WITH {_fidelity_sql(['price', 'score', 'month'], ['status', 'priority'])} SELECT test, variable, metric, round(value, 6) AS value, threshold, passed FROM fidelity")
def fidelity_report(spark, sf):
    real, synthetic = _sides(spark, sf)
    return rounded(validation.fidelity(real, synthetic, ["price", "score", "month"], ["status", "priority"]))


@query(
    f"""WITH {_fidelity_sql(['price', 'score'], ['status'])}, rate AS (SELECT avg(passed::INT) FILTER (passed IS NOT NULL) AS pass_rate FROM fidelity)
    SELECT round(pass_rate, 6) AS pass_rate, CASE WHEN pass_rate >= 0.8 THEN 'excellent' WHEN pass_rate >= 0.6 THEN 'acceptable' ELSE 'poor' END AS verdict FROM rate"""
)
def fidelity_verdict(spark, sf):
    real, synthetic = _sides(spark, sf)
    return rounded(validation.fidelity_verdict(validation.fidelity(real, synthetic, ["price", "score"], ["status"])))


@query()
def validation_report(spark, sf):
    e = vectors(spark, sf).withColumn("subject", F.col("vec_id") % 97).withColumn("label", F.col("label").cast("string"))
    real, synthetic = halves(e, "vec_id")
    return rounded(validation.full_report(real, synthetic, "vec_id", "subject", FEATURES, ["label"], target="label", time="vec_id"))


@query(
    f"""WITH v AS (SELECT *, month(visit)::DOUBLE AS month FROM ({ORDER_VISITS_SQL}) WHERE price IS NOT NULL AND score IS NOT NULL AND visit IS NOT NULL),
    r AS (SELECT * FROM v WHERE row_id % 2 = 0 AND month < 7), b AS (SELECT min(month) - 0.05 * (max(month) - min(month)) AS lo, max(month) + 0.05 * (max(month) - min(month)) AS hi FROM r),
    s AS (SELECT v.* FROM v, b WHERE row_id % 2 = 1 AND month BETWEEN lo AND hi),
    l AS (SELECT 'price' AS variable, price AS v, 1 AS side FROM r UNION ALL SELECT 'price', price, 0 FROM s UNION ALL SELECT 'score', score, 1 FROM r UNION ALL SELECT 'score', score, 0 FROM s),
    c AS (SELECT variable, v, sum(sum(side)) OVER w AS a, sum(sum(1 - side)) OVER w AS b FROM l GROUP BY variable, v WINDOW w AS (PARTITION BY variable ORDER BY v))
    SELECT variable, (SELECT count(*) FROM r) AS n_real, (SELECT count(*) FROM s) AS n_synthetic,
      round(max(abs(a / (SELECT count(*) FROM r)::DOUBLE - b / (SELECT count(*) FROM s)::DOUBLE)), 6) AS statistic FROM c GROUP BY variable"""
)
def age_matched_gaps(spark, sf):
    """What the age-matching mode tests: gaps of the distributions once the synthetic rows lie in the real range."""
    real, synthetic = _sides(spark, sf)
    real, synthetic = validation.age_matched(real.where("month < 7"), synthetic, "row_id", "month")
    return rounded(stats.ks_statistic(real, synthetic, ["price", "score"]))


@query(f"WITH {_fidelity_sql(['price', 'score'], [], _AGE_MATCHED_SQL)} SELECT test, variable, metric, round(value, 6) AS value, threshold, passed FROM fidelity")
def validation_age_matching(spark, sf):
    real, synthetic = _sides(spark, sf)
    return rounded(validation.validate(real.where("month < 7"), synthetic, "row_id", "subject", ["price", "score", "absent"], ["status"], "age_matching", age="month"))


@query()
def tstr_forest(spark, sf):
    # numbers in place of texts before the join, in one pass over the texts; runs of other characters go at once
    words = F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    f = t(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 61).alias("subject"), F.length("text").cast("double").alias("size"), (F.length("text") / words).alias("mean_word"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("double").alias("capitals"), F.length(F.regexp_replace("text", "[^%$#*&!|]+", "")).cast("double").alias("symbols"),
    )
    f = materialize(f.join(t(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id"))
    real, synthetic = halves(f, "doc_id")
    return rounded(validation.utility(real, synthetic, "subject", ["size", "mean_word", "capitals", "symbols"], "quality"))


@query("SELECT user_id AS subject, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS visits, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_visits(spark, sf):
    return rounded(streaming.windowed_counts(t(spark, sf, "events").withColumnRenamed("user_id", "subject"), "subject", "ts", "value", "1 day"))


@query(
    """WITH g AS (SELECT user_id AS subject, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT subject, ts, sum(fresh) OVER (PARTITION BY subject ORDER BY ts) AS no FROM g) SELECT subject, min(ts) AS start, count(*) AS visits FROM s GROUP BY subject, no"""
)
def visit_sessions(spark, sf):
    out = streaming.visit_sessions(t(spark, sf, "events").withColumnRenamed("user_id", "subject"), "subject", "ts", "12 hours")
    return out.select("subject", "start", "visits")
