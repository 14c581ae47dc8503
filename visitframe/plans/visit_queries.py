"""Windows over visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import visits as V
from visitframe.plans.base import ORDER_VISITS_SQL as O
from visitframe.plans.base import SHIP_VISITS_SQL as S
from visitframe.plans.base import order_visits, query, rounded, ship_visits, t

EVENTS = "SELECT user_id AS subject, ts, event_id, event_type, value FROM events"


def _events(spark, sf):
    return t(spark, sf, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", "event_type", "value")


@query(f"SELECT row_id, round_even(date_diff('day', min(visit) OVER (PARTITION BY subject), visit) / 30.44, 0)::BIGINT AS visit_month FROM ({O})")
def visit_month(spark, sf):
    return V.visit_month(order_visits(spark, sf), "subject", "visit").select("row_id", "visit_month")


@query(
    f"""WITH v AS (SELECT *, (code IS NULL)::INT + (price IS NULL)::INT + (score IS NULL)::INT AS nulls,
      CASE WHEN code = 'bl' OR code LIKE 'm%' THEN 0 ELSE 1 END AS cr FROM ({S.replace("quantity,", "price,").replace("amount,", "score,")}) WHERE true),
    g AS (SELECT *, count(*) OVER w AS n, min(nulls) OVER w AS least, (SELECT 1) AS one FROM v WINDOW w AS (PARTITION BY subject, visit)),
    d AS (SELECT subject, visit, count(DISTINCT price) + count(DISTINCT score) AS dist FROM v GROUP BY ALL),
    h AS (SELECT g.*, dist = 2 AS equal, sum((nulls = least)::INT) OVER (PARTITION BY g.subject, g.visit) AS tied,
      max(CASE WHEN nulls = least THEN 1 - cr END) OVER (PARTITION BY g.subject, g.visit) AS coded FROM g JOIN d USING (subject, visit)),
    r AS (SELECT *, row_number() OVER (PARTITION BY subject, visit ORDER BY CASE WHEN equal THEN 0 ELSE nulls END, CASE WHEN equal THEN 0 ELSE cr END, row_id) AS no FROM h)
    SELECT row_id, CASE WHEN n = 1 THEN NULL WHEN equal THEN 'Equal values' WHEN tied = 1 THEN 'Min null values' WHEN coded = 1 THEN 'VISITCODE priority'
      ELSE 'first row, same VISITCODE' END AS strategy FROM r WHERE no = 1"""
)
def dedup_same_date(spark, sf):
    df = ship_visits(spark, sf).select("subject", "visit", "row_id", "code", F.col("quantity").alias("price"), F.col("amount").alias("score"))
    return V.one_row_per_visit(df, "subject", "visit", "code", ["price", "score"], ["row_id"]).select("row_id", "strategy")


@query(
    f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY subject, visit ORDER BY (quantity IS NULL)::INT + (amount IS NULL)::INT,
      CASE flag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, tax DESC, row_id) AS no FROM ({S})) WHERE no = 1"""
)
def best_row_of_group(spark, sf):
    status = F.when(F.col("flag") == "A", "complete").when(F.col("flag") == "R", " Partial").otherwise("x")
    df = ship_visits(spark, sf).withColumn("status", status)
    return V.best_row(df, ["subject", "visit"], ["quantity", "amount"], ["row_id"], "status", "tax").select("row_id")


@query(
    f"""WITH v AS (SELECT *, (price IS NULL)::INT + (score IS NULL)::INT + (code IS NULL)::INT AS nulls FROM ({O}))
    SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY subject, visit ORDER BY nulls, row_id) AS no FROM v WHERE visit IS NOT NULL) WHERE no = 1
    UNION ALL SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY subject, code ORDER BY nulls, row_id) AS no FROM v WHERE visit IS NULL AND nulls <= 1) WHERE no = 1"""
)
def dedup_dated_and_undated(spark, sf):
    return V.dedup_visits(order_visits(spark, sf), "subject", "visit", "code", ["price", "score", "code"], ["row_id"], least=2).select("row_id")


@query(
    f"""SELECT row_id, coalesce(quantity, first_value(quantity IGNORE NULLS) OVER w) AS quantity,
      CASE WHEN max(CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END) OVER w IS NOT NULL
        THEN CASE max(CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END) OVER w WHEN 1 THEN 'A' ELSE 'R' END ELSE flag END AS flag,
      CASE WHEN code <> 'm00' THEN code ELSE coalesce(first_value(CASE WHEN code <> 'm00' THEN code END IGNORE NULLS) OVER w, code) END AS code
    FROM ({S}) WINDOW w AS (PARTITION BY subject, visit ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def consolidate_group(spark, sf):
    df = ship_visits(spark, sf)
    out = V.consolidate(df, ["subject", "visit"], ["quantity"], ["row_id"], {"flag": ["A", "R"]}, {"code": F.col("code") != "m00"})
    return out.select("row_id", "quantity", "flag", "code")


@query(
    f"""WITH v AS (SELECT * FROM ({S})), p AS (SELECT subject, visit, max(quantity) AS m FROM v GROUP BY ALL),
    q AS (SELECT subject, visit, lag(m) OVER (PARTITION BY subject ORDER BY visit) AS prev FROM p)
    SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY subject, visit ORDER BY tax DESC NULLS LAST,
      CASE WHEN coalesce(quantity >= prev, false) THEN 0 ELSE 1 END, row_id) AS no FROM v JOIN q USING (subject, visit)) WHERE no = 1"""
)
def update_stamp_trend(spark, sf):
    return V.newest_then_trend(ship_visits(spark, sf), "subject", "visit", "tax", "quantity", ["row_id"]).select("row_id")


@query()
def merge_two_measures(spark, sf):
    df = ship_visits(spark, sf).select("subject", "row_id", "visit", (F.col("quantity")).alias("a"), (F.col("amount") / 2000).alias("b"))
    return V.merge_two_sources(df, "subject", "visit", "a", "b", "merged", 0, 40)


@query(
    f"""WITH e AS (SELECT subject, ts::DATE AS day, event_id, value, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'bl' ELSE 'm' || lpad((event_id % 30)::VARCHAR, 2, '0') END AS code
      FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY subject, ts::DATE ORDER BY event_id) = 1),
    l AS (SELECT *, last_value(CASE WHEN code IS NOT NULL THEN {{'m': CASE WHEN code = 'bl' THEN 0 ELSE substr(code, 2)::INT END, 'd': day}} END IGNORE NULLS)
      OVER (PARTITION BY subject ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
    SELECT event_id, coalesce(code, CASE WHEN last IS NULL THEN 'bl' ELSE 'm' || lpad((last.m + round_even(date_diff('day', last.d, day) / 30.44, 0)::INT)::VARCHAR, 2, '0') END) AS code FROM l"""
)
def impute_visit_code(spark, sf):
    k = F.col("event_id")
    code = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "bl").otherwise(F.concat(F.lit("m"), F.lpad((k % 30).cast("string"), 2, "0")))
    df = _events(spark, sf).select("subject", F.col("ts").cast("date").alias("day"), "event_id", "value", code.alias("code"))
    first = V.keep_first(df, ["subject", "day"], ["event_id"])
    return V.impute_visit_code(first, "subject", "day", "code", ["value"]).select("event_id", "code")


@query(
    f"""WITH e AS (SELECT subject, event_id, CASE WHEN subject % 4 = 0 AND event_id % 2 = 0 THEN 'f' WHEN subject % 4 = 1 AND event_id % 2 = 0 THEN 'sc' ELSE 'm06' END AS code FROM ({EVENTS})),
    n AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM e)
    SELECT event_id, CASE WHEN code IN ('f', 'sc') THEN '0' ELSE code END AS code FROM n WHERE n > 1 OR code NOT IN ('f', 'sc')"""
)
def recode_codes(spark, sf):
    from visitframe.operators.cleaning import drop_single_visit_codes

    even = F.col("event_id") % 2 == 0
    code = F.when((F.col("subject") % 4 == 0) & even, "f").when((F.col("subject") % 4 == 1) & even, "sc").otherwise("m06")
    df = _events(spark, sf).select("subject", "event_id", code.alias("code"))
    return drop_single_visit_codes(df, "subject", "code").select("event_id", "code")


@query(f"SELECT subject, arg_min(price, visit) FILTER (WHERE price IS NOT NULL AND visit IS NOT NULL) AS price, arg_min(code, visit) FILTER (WHERE code IS NOT NULL AND visit IS NOT NULL) AS code FROM (SELECT * FROM ({O}) QUALIFY row_number() OVER (PARTITION BY subject, visit ORDER BY row_id) = 1) GROUP BY subject")
def baseline_snapshot(spark, sf):
    df = V.keep_first(order_visits(spark, sf), ["subject", "visit"], ["row_id"])
    return V.baseline_snapshot(df, "subject", "visit", ["price", "code"])


@query(f"SELECT event_id FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY ts DESC) <= 2")
def last_n_visits(spark, sf):
    return V.last_visits(_events(spark, sf), "subject", "ts", 2).select("event_id")


@query(f"SELECT event_id FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY ts) > 1")
def all_but_first_visit(spark, sf):
    return V.first_visit(_events(spark, sf), "subject", "ts", rest=True).select("event_id")


@query(f"SELECT event_id FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY subject, event_type ORDER BY event_id) = 1")
def keep_first_per_key(spark, sf):
    return V.keep_first(_events(spark, sf), ["subject", "event_type"], ["event_id"]).select("event_id")


@query(f"SELECT event_id, round((value - min(value) OVER (PARTITION BY subject)) * 12, 6) AS month FROM ({EVENTS})")
def months_from_baseline(spark, sf):
    return rounded(V.months_from_baseline(_events(spark, sf), "subject", "value").select("event_id", "month"))


@query(f"WITH d AS (SELECT subject, abs(lead(value) OVER (PARTITION BY subject ORDER BY ts) - value) AS d FROM ({EVENTS})) SELECT subject, round(max(d), 6) AS value FROM d GROUP BY subject")
def max_consecutive_change(spark, sf):
    return rounded(V.largest_step(_events(spark, sf), "subject", "ts", ["value"]))


@query("SELECT c_custkey, printf('S%05d', dense_rank() OVER (ORDER BY c_custkey) - 1) AS label FROM customer")
def renumber_subjects(spark, sf):
    return V.renumber(t(spark, sf, "customer").select("c_custkey"), "c_custkey", "label").select("c_custkey", "label")


@query(
    f"""WITH f AS (SELECT subject, min(ts) FILTER (WHERE value >= 50) AS a, min(ts) FILTER (WHERE value < 5) AS b, min(ts) FILTER (WHERE event_id % 10 >= 8) AS c FROM ({EVENTS}) GROUP BY subject),
    l AS (SELECT subject, unnest([{{'t': a, 'm': 'high'}}, {{'t': b, 'm': 'low'}}, {{'t': c, 'm': 'odd'}}]) AS e FROM f)
    SELECT subject, coalesce(string_agg(e.m, ' > ' ORDER BY e.t, e.m) FILTER (WHERE e.t IS NOT NULL), '') AS sequence FROM l GROUP BY subject"""
)
def first_crossing_sequence(spark, sf):
    df = _events(spark, sf).select("subject", "ts", F.col("value").alias("high"), F.col("value").alias("low"), (F.col("event_id") % 10).alias("odd"))
    return V.first_crossings(df, "subject", "ts", {"high": (">=", 50), "low": ("<", 5), "odd": (">=", 8)})


_SEQUENCES = f"""f AS (SELECT subject, min(ts) FILTER (WHERE value >= 50) AS a, min(ts) FILTER (WHERE value < 5) AS b, min(ts) FILTER (WHERE event_id % 10 >= 8) AS c,
    min(ts) FILTER (WHERE value >= 20) AS d FROM ({EVENTS}) GROUP BY subject),
    l AS (SELECT subject, unnest([{{'t': a, 'm': 'high'}}, {{'t': b, 'm': 'low'}}, {{'t': c, 'm': 'odd'}}, {{'t': d, 'm': 'middle'}}]) AS e FROM f),
    q AS (SELECT subject, coalesce(string_agg(e.m, ' > ' ORDER BY e.t, e.m) FILTER (WHERE e.t IS NOT NULL), '') AS sequence FROM l GROUP BY subject)"""


def _sequences(spark, sf):
    columns = [F.col("value").alias(c) for c in ("high", "low", "middle")]
    df = _events(spark, sf).select("subject", "ts", *columns, (F.col("event_id") % 10).alias("odd"))
    return V.first_crossings(df, "subject", "ts", {"high": (">=", 50), "low": ("<", 5), "odd": (">=", 8), "middle": (">=", 20)})


@query(
    f"""WITH {_SEQUENCES}, n AS (SELECT sequence, count(*) AS n FROM q GROUP BY sequence)
    SELECT row_number() OVER (ORDER BY n DESC, sequence)::INT AS rank, sequence, n, round(n / (SELECT sum(n) FROM n)::DOUBLE, 6) AS share FROM n WHERE sequence <> '' QUALIFY rank <= 10"""
)
def top_sequences(spark, sf):
    return rounded(V.top_sequences(_sequences(spark, sf)))


@query(
    f"""WITH {_SEQUENCES}, n AS (SELECT subject % 2 AS side, sequence, count(*) AS n FROM q WHERE sequence <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, sequence) AS rank FROM n),
    c AS (SELECT a.sequence, a.n AS x, b.n AS y, a.rank AS ra, b.rank AS rb FROM r a JOIN r b ON a.side = 0 AND b.side = 1 AND a.sequence = b.sequence WHERE a.rank <= 10 AND b.rank <= 10),
    p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x <> b.x AS dx, a.y <> b.y AS dy FROM c a JOIN c b ON a.sequence < b.sequence),
    t AS (SELECT (sum(s) / sqrt(count(*) FILTER (WHERE dx) * count(*) FILTER (WHERE dy)))::DOUBLE AS tau FROM p),
    o AS (SELECT count(*) / 5.0::DOUBLE AS overlap FROM c WHERE ra <= 5 AND rb <= 5)
    SELECT round(overlap, 6) AS overlap, (SELECT count(*) FROM c) AS n_common, round(tau, 6) AS tau, overlap >= 0.6 AND tau > 0.5 AS passed FROM o, t"""
)
def sequence_comparison(spark, sf):
    q = _sequences(spark, sf)
    return rounded(V.compare_sequences(q.where("subject % 2 = 0"), q.where("subject % 2 = 1")).drop("p_value"))


@query()
def strictly_increasing_times(spark, sf):
    df = _events(spark, sf).select("subject", "event_id", F.dayofmonth("ts").cast("double").alias("day"))
    return V.strictly_increasing(df, "subject", "day")


@query(
    f"""WITH v AS (SELECT subject, (day(ts) // 3 * 3)::BIGINT AS month, value, event_type FROM ({EVENTS})),
    e AS (SELECT subject, min(month) AS a, max(month) AS b, min(event_type) AS kind FROM v GROUP BY subject),
    g AS (SELECT subject, kind, unnest(range(a, b + 1, 3)) AS month FROM e), s AS (SELECT subject, month, max(value) AS value FROM v GROUP BY ALL)
    SELECT g.subject, g.month, kind, value, (value IS NOT NULL)::INT AS value_mask FROM g LEFT JOIN s ON s.subject = g.subject AND s.month = g.month"""
)
def densify_grid(spark, sf):
    df = _events(spark, sf).select("subject", (F.floor(F.dayofmonth("ts") / 3) * 3).cast("long").alias("month"), "value", "event_type")
    kind = df.groupBy("subject").agg(F.min("event_type").alias("kind"))
    return V.densify(df.join(kind, "subject"), "subject", "month", 3, ["kind"], ["value"]).select("subject", "month", "kind", "value", "value_mask")


@query(f"SELECT min(day(ts)) AS start, max(day(ts)) AS \"end\" FROM ({EVENTS}) WHERE value BETWEEN 10 AND 23")
def curve_interval(spark, sf):
    df = _events(spark, sf).select(F.dayofmonth("ts").cast("long").alias("day"), "value")
    return V.curve_interval(df, "day", "value", 10, 23)
