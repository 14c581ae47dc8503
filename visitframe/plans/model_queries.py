"""Encoding, scaling, statistics, privacy, splits and course scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import course, encoding, privacy, splitting, stats, timeseries
from visitframe.plans.base import ORDER_VISITS_SQL as O
from visitframe.plans.base import SHIP_VISITS_SQL as S
from visitframe.plans.base import halves, order_visits, query, rounded, ship_visits, t
from visitframe.plans.matching_queries import FEATURES, vectors

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS \"seg/{s}\"" for s in _SEGMENTS) + " FROM customer")
def dummies(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return encoding.dummies(df, "seg", _SEGMENTS)


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def undummies(spark, sf):
    return encoding.undummies(dummies(spark, sf), "seg", "segment")


@query("SELECT 'seg' AS prefix, 5::BIGINT AS columns")
def detect_dummies(spark, sf):
    found = encoding.dummy_groups(dummies(spark, sf).withColumn("n/x", F.col("c_custkey")))
    return spark.createDataFrame([(p, len(c)) for p, c in found.items()], "prefix string, columns long")


@query("SELECT n_nationkey, ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][n_regionkey + 1] AS region FROM nation")
def label_decode(spark, sf):
    labels = {0: "AFRICA", 1: "AMERICA", 2: "ASIA", 3: "EUROPE", 4: "MIDDLE EAST"}
    return t(spark, sf, "nation").select("n_nationkey", encoding.decode_labels(F.col("n_regionkey"), labels).alias("region"))


@query("SELECT c_custkey, c_acctbal AS balance, c_mktsegment FROM customer")
def dictionary_projection(spark, sf):
    df = t(spark, sf, "customer")
    kept = encoding.keep_known(df, ["c_custkey", "c_acctbal", "c_name"], ["c_mktsegment"], ["c_name"])
    return encoding.rename_known(kept, {"c_acctbal": "balance", "c_custkey": None})


@query("SELECT c_custkey, c_acctbal FROM customer")
def align_columns(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    generated = df.select(F.col("c_acctbal").alias("generated_c_acctbal"), F.col("c_custkey").alias("generated_c_custkey"), F.lit(1).alias("generation_id"))
    return encoding.align_columns(df, generated)[1]


@query("SELECT c_custkey, c_name FROM customer")
def drop_empty_columns(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("double").alias("empty"))
    return encoding.drop_empty_columns(df)


@query(
    f"""WITH v AS (SELECT subject::VARCHAR AS ID, date_part('year', visit)::DOUBLE AS TIME, price, score, row_id FROM ({O}) WHERE visit IS NOT NULL),
    f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY ID, TIME ORDER BY row_id) = 1)
    SELECT ID, TIME, price, score FROM f QUALIFY count(*) OVER (PARTITION BY ID) > 1"""
)
def model_frame(spark, sf):
    df = order_visits(spark, sf).withColumn("year", F.year("visit").cast("double"))
    return encoding.model_frame(df, "subject", "year", ["price"], ["score", "absent"], order=["row_id"])


@query(
    """WITH d(file_code, variable_code, kind) AS (VALUES ('a', 'SEX', 'cofactor'), ('a', 'GONE', 'scale'), ('b', 'X', 'scale'))
    SELECT file_code, variable_code, kind FROM d WHERE variable_code <> 'GONE' UNION ALL SELECT 'a', 'SEX/M', 'cofactor' UNION ALL SELECT 'a', 'NEW', NULL"""
)
def sync_dictionary(spark, sf):
    d = spark.createDataFrame([("a", "SEX", "cofactor"), ("a", "GONE", "scale"), ("b", "X", "scale")], "file_code string, variable_code string, kind string")
    return encoding.sync_dictionary(d, "a", ["SEX", "SEX/M", "NEW"])


@query("SELECT p_brand AS file_code, p_type AS kind, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS variables FROM part GROUP BY ALL")
def metadata_lists(spark, sf):
    d = t(spark, sf, "part").select(F.col("p_brand").alias("file_code"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("variable_code"))
    return encoding.metadata_lists(d, "type")


@query("SELECT coalesce(o_orderpriority, 'unknown') AS method, round(quantile_cont(o_totalprice, 0.01), 6) AS low, round(quantile_cont(o_totalprice, 0.99), 6) AS high FROM orders GROUP BY 1")
def method_settings(spark, sf):
    return rounded(encoding.settings_of(t(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


@query(
    """WITH o AS (SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'unknown' ELSE o_orderpriority END AS method, o_totalprice AS price, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS key FROM orders)
    SELECT 'price' AS variable, '1-URGENT' AS method, 10.0::DOUBLE AS low, 20.0::DOUBLE AS high WHERE EXISTS (FROM o WHERE method = '1-URGENT')
    UNION ALL SELECT 'price', 'unknown', round(quantile_cont(price, 0.01), 6), round(quantile_cont(price, 0.99), 6) FROM o WHERE method = 'unknown' GROUP BY ALL
    UNION ALL SELECT 'key', '2-HIGH', 3, 4 WHERE EXISTS (FROM o WHERE method = '2-HIGH') UNION ALL SELECT 'Lvol', NULL, 0, 9"""
)
def normalization_settings(spark, sf):
    o = t(spark, sf, "orders")
    low = F.col("o_orderpriority") == "5-LOW"
    df = o.select(F.when(low, "unknown").otherwise(F.col("o_orderpriority")).alias("METHOD"), F.col("o_totalprice").alias("price"), F.when(~low, F.col("o_custkey")).alias("key"), F.lit(1).alias("Lvol"), F.lit(1).alias("Rvol"))
    settings = {"price": {"1-URGENT": (10, 20), "gone": (1, 2), "unknown": (0, 0)}, "key": {"2-HIGH": (3, 4), "unknown": (0, 0)}, "Lvol": (0, 1), "Rvol": (0, 1), "absent": (0, 1)}
    return rounded(encoding.normalization_settings(df, settings, {"Lvol": (0, 9), "gone": (0, 1)}, drop_right=True))


@query("SELECT l_orderkey, l_linenumber, round(least(greatest((l_quantity - 5) / 40, 0), 1), 6) AS l_quantity, round(least(greatest(1 - l_tax / 0.05, 0), 1), 6) AS l_tax FROM lineitem")
def normalize_fixed(spark, sf):
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(encoding.normalize_fixed(df, {"l_quantity": (5, 45, "increasing"), "l_tax": (0, 0.05, "inverse"), "absent": (0, 1, "increasing")}))


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 6) AS p_retailprice FROM part")
def normalize_minmax(spark, sf):
    return rounded(encoding.normalize_minmax(t(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]))


@query(
    """SELECT l_orderkey, l_linenumber, round_even(l_discount * 30, 0)::BIGINT AS up,
    CASE WHEN (30 - l_discount * 30) - floor(30 - l_discount * 30) <= 0.5 THEN floor(30 - l_discount * 30) ELSE ceil(30 - l_discount * 30) END::BIGINT AS down FROM lineitem"""
)
def denormalize(spark, sf):
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("up"), F.col("l_discount").alias("down"))
    return encoding.denormalize(df, {"up": (0, 30, "increasing"), "down": (0, 30, "inverse")})


@query(f"SELECT row_id, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM ({S}))) AS quantity FROM ({S})")
def median_impute(spark, sf):
    return encoding.median_impute(ship_visits(spark, sf).select("row_id", "quantity"), ["quantity"])


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 5) AS p_retailprice FROM part")
def standardize(spark, sf):
    return rounded(encoding.standardize(t(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]), 5)


@query(
    """WITH e AS (SELECT user_id AS subject, epoch(ts) / 86400 AS day, value FROM events), w AS (SELECT DISTINCT user_id AS subject, d::DOUBLE AS day FROM events, (VALUES (19725), (19731), (19738)) t(d)),
    c AS (SELECT w.subject, w.day, (SELECT max(e.day) FROM e WHERE e.subject = w.subject AND e.day <= w.day) AS a, (SELECT min(e.day) FROM e WHERE e.subject = w.subject AND e.day >= w.day) AS b FROM w)
    SELECT c.subject, c.day, round(CASE WHEN a IS NULL THEN y.value WHEN b IS NULL OR a = b THEN x.value ELSE x.value + (c.day - a) / (b - a) * (y.value - x.value) END, 5) AS value
    FROM c LEFT JOIN e x ON x.subject = c.subject AND x.day = a LEFT JOIN e y ON y.subject = c.subject AND y.day = b"""
)
def interpolate_at(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("subject"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).alias("day"), "value")
    days = e.select("subject").distinct().withColumn("day", F.explode(F.array(*[F.lit(float(d)) for d in (19725, 19731, 19738)])))
    return rounded(encoding.interpolate_at(e, days, "subject", "day", ["value"]), 5)


@query(
    """WITH r AS (SELECT quantile_cont(value, list_transform(range(0, 1001), lambda k: k / 1000.0)) AS q FROM events WHERE event_id % 2 = 0),
    s AS (SELECT event_id, cume_dist() OVER (ORDER BY value) * 1000 AS pos FROM events WHERE event_id % 2 = 1)
    SELECT event_id, round(q[floor(pos)::INT + 1] + (pos - floor(pos)) * (q[least(floor(pos)::INT + 2, 1001)] - q[floor(pos)::INT + 1]), 6) AS value FROM s, r"""
)
def quantile_map(spark, sf):
    real, synthetic = halves(t(spark, sf, "events").select("event_id", "value"), "event_id")
    return rounded(encoding.quantile_map(synthetic, real, "value", "event_id"))


@query(
    """WITH r AS (SELECT l_quantity AS v FROM lineitem WHERE l_orderkey % 2 = 0), s AS (SELECT l_quantity AS v FROM lineitem WHERE l_orderkey % 2 = 1),
    p AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT v, 1 AS a, 0 AS b FROM r UNION ALL SELECT v, 0, 1 FROM s) GROUP BY v),
    c AS (SELECT sum(a) OVER (ORDER BY v)::DOUBLE / (SELECT count(*) FROM r) - sum(b) OVER (ORDER BY v)::DOUBLE / (SELECT count(*) FROM s) AS d FROM p)
    SELECT 'l_quantity' AS variable, (SELECT count(*) FROM r) AS n_real, (SELECT count(*) FROM s) AS n_synthetic, round(max(abs(d)), 6) AS statistic FROM c"""
)
def ks_stat(spark, sf):
    return rounded(stats.ks_statistic(*halves(t(spark, sf, "lineitem"), "l_orderkey"), ["l_quantity"]))


@query(
    """WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS r, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS s FROM orders GROUP BY 1),
    t AS (SELECT sum(r) AS tr, sum(s) AS ts FROM c) SELECT 'o_orderpriority' AS variable, round(sum((s - r * ts / tr) ** 2 / (r * ts / tr)), 6) AS statistic, count(*) - 1 AS degrees FROM c, t"""
)
def chi2_stat(spark, sf):
    return rounded(stats.chi_square(*halves(t(spark, sf, "orders"), "o_orderkey"), "o_orderpriority"))


_CORR = [("quantity", "amount"), ("quantity", "tax"), ("amount", "tax")]


@query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT corr({a}, {b}) FILTER (WHERE row_id // 8 % 2 = 0 AND {a} IS NOT NULL AND {b} IS NOT NULL) AS x, corr({a}, {b}) FILTER (WHERE row_id // 8 % 2 = 1 AND {a} IS NOT NULL AND {b} IS NOT NULL) AS y FROM ({S})" for a, b in _CORR)
    + ") SELECT round(sum(abs(x - y)) * 2 / 9, 6) AS mad, round(corr(x, y), 6) AS meta_correlation FROM c"
)
def corr_mad(spark, sf):
    df = ship_visits(spark, sf)
    half = F.floor(F.col("row_id") / 8) % 2
    return rounded(stats.correlation_distance(df.where(half == 0), df.where(half == 1), ["quantity", "amount", "tax"]))


_PAIR = f"(SELECT quantity * 1500 AS x, amount AS y FROM ({S}) WHERE quantity IS NOT NULL AND amount IS NOT NULL)"


def _pairs(spark, sf):
    return ship_visits(spark, sf).where("quantity is not null and amount is not null").select("row_id", (F.col("quantity") * 1500).alias("x"), F.col("amount").alias("y"))


@query(f"SELECT count(*) AS n, round(avg(x - y), 4) AS mean_difference, round(stddev(x - y), 4) AS sd, round(avg(x - y) / (stddev(x - y) / sqrt(count(*))), 4) AS t, round(avg(x - y) / stddev(x - y), 4) AS cohens_d, round(avg(x - y) - 1.96 * stddev(x - y) / sqrt(count(*)), 4) AS low, round(avg(x - y) + 1.96 * stddev(x - y) / sqrt(count(*)), 4) AS high FROM {_PAIR}")
def paired_t(spark, sf):
    return rounded(stats.paired_t(_pairs(spark, sf), "x", "y"), 4)


@query(f"SELECT count(*) AS n, round(avg(x - y), 4) AS bias, round(stddev(x - y), 4) AS sd, round(avg(x - y) - 1.96 * stddev(x - y), 4) AS lower, round(avg(x - y) + 1.96 * stddev(x - y), 4) AS upper, round(1.96 * stddev(x - y), 4) AS repeatability, round(100 * avg(x - y) / avg((x + y) / 2), 4) AS percent_bias, round(100 * 1.96 * stddev(x - y) / avg((x + y) / 2), 4) AS percent_error FROM {_PAIR}")
def bland_altman(spark, sf):
    return rounded(stats.bland_altman(_pairs(spark, sf), "x", "y"), 4)


@query(f"SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(2 * covar_samp(x, y) / (var_samp(x) + var_samp(y) + (avg(x) - avg(y)) ** 2), 6) AS ccc FROM {_PAIR}")
def ccc(spark, sf):
    return rounded(stats.concordance(_pairs(spark, sf), "x", "y"))


@query()
def ccc_interval(spark, sf):
    return rounded(stats.concordance_bootstrap(_pairs(spark, sf), "x", "y", "row_id"))


@query(
    f"""WITH s AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop((x + y) / 2) AS vm, var_pop(x) AS vx, var_pop(y) AS vy FROM {_PAIR}),
    q AS (SELECT n, 2 * n * vm AS sr, n * ((mx - (mx + my) / 2) ** 2 + (my - (mx + my) / 2) ** 2) AS sc, n * (vx + vy) AS sw FROM s),
    m AS (SELECT n, sr / (n - 1) AS msr, sc AS msc, (sw + sc - sr - sc) / (n - 1) AS mse FROM q)
    SELECT n::BIGINT AS n, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc_single, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc_average FROM m"""
)
def icc(spark, sf):
    return rounded(stats.intraclass(_pairs(spark, sf), "x", "y"))


@query(
    f"""WITH s AS (SELECT var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, avg(x) AS mx, avg(y) AS my FROM {_PAIR}),
    d AS (SELECT (yy - xx + sqrt((yy - xx) ** 2 + 4 * xy ** 2)) / (2 * xy) AS slope, mx, my FROM s) SELECT round(slope, 5) AS slope, round(my - slope * mx, 5) AS intercept FROM d"""
)
def deming(spark, sf):
    return rounded(stats.deming(_pairs(spark, sf), "x", "y"), 5)


@query(
    f"""WITH d AS (SELECT x - y AS d FROM {_PAIR} WHERE x <> y), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d)
    SELECT count(*) AS n, sum(r) FILTER (WHERE d > 0) AS w_plus, sum(r) FILTER (WHERE d < 0) AS w_minus FROM r"""
)
def signed_rank(spark, sf):
    return stats.signed_rank(_pairs(spark, sf), "x", "y")


@query(
    """WITH d AS (SELECT p_partkey AS k, p_retailprice - 20.0 * p_size AS d FROM part)
    SELECT round(quantile_cont((a.d + b.d) / 2, 0.5), 6) AS pseudo_median FROM d a JOIN d b ON a.k <= b.k"""
)
def hodges_lehmann(spark, sf):
    return rounded(stats.pseudo_median(t(spark, sf, "part").select(F.col("p_retailprice").alias("x"), (20.0 * F.col("p_size")).alias("y")), "x", "y"))


@query(
    """WITH p AS (SELECT sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice) AS s, a.p_size <> b.p_size AS dx, a.p_retailprice <> b.p_retailprice AS dy FROM part a JOIN part b ON a.p_partkey < b.p_partkey)
    SELECT (SELECT count(*) FROM part) AS n, round((sum(s) / sqrt(count(*) FILTER (WHERE dx) * count(*) FILTER (WHERE dy)::DOUBLE))::DOUBLE, 6) AS tau FROM p"""
)
def kendall_tau(spark, sf):
    found = stats.kendall_tau(t(spark, sf, "part"), "p_size", "p_retailprice")
    return rounded(spark.createDataFrame([(found["n"], found["tau"])], "n long, tau double"))


_MOMENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round(avg(({c} - m) ** 3) / v ** 1.5, 6) AS skewness, round(avg(({c} - m) ** 4) / v ** 2 - 3, 6) AS kurtosis "
    f"FROM lineitem, (SELECT avg({c}) AS m, var_pop({c}) AS v FROM lineitem) GROUP BY v"
    for c in ("l_quantity", "l_extendedprice")
)


@query(_MOMENTS)
def moments(spark, sf):
    return rounded(stats.moments(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(
    """WITH r AS (SELECT o_orderpriority AS c, count(*)::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    s AS (SELECT o_orderpriority AS c, count(*)::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1) AS q FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT round(sum(p * ln(p / q)), 8) AS kl FROM r JOIN s USING (c)"""
)
def kl_divergence(spark, sf):
    return rounded(stats.kl_divergence(*halves(t(spark, sf, "orders"), "o_orderkey"), "o_orderpriority"), 8)


@query(
    """WITH l AS (SELECT l_returnflag AS f, l_quantity AS s FROM lineitem), r AS (SELECT f, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM l)
    SELECT 'A' AS class, round((sum(r) FILTER (WHERE f = 'A') - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM r, (SELECT count(*) FILTER (WHERE f = 'A')::DOUBLE AS p, count(*)::DOUBLE AS n FROM l) GROUP BY p, n"""
)
def auc_one_vs_rest(spark, sf):
    return rounded(stats.auc_by_class(t(spark, sf, "lineitem"), "l_returnflag", [("A", "l_quantity")]))


@query(
    f"""WITH r AS (SELECT status, avg(price) AS a, stddev(price) AS b FROM ({O}) WHERE row_id % 2 = 0 GROUP BY 1), s AS (SELECT status, avg(price) AS c, stddev(price) AS d FROM ({O}) WHERE row_id % 2 = 1 GROUP BY 1)
    SELECT status, round(a, 4) AS real_mean, round(b, 4) AS real_std, round(c, 4) AS synthetic_mean, round(d, 4) AS synthetic_std, abs(a - c) < 0.2 * b AS close FROM r JOIN s USING (status)"""
)
def trajectory_difference(spark, sf):
    return rounded(stats.trajectory_difference(*halves(order_visits(spark, sf), "row_id"), ["status"], "price"), 4)


@query(
    """WITH s AS (SELECT count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS a, sum(p_size ** 2)::DOUBLE AS b, sum(p_size ** 3)::DOUBLE AS c, sum(p_size ** 4)::DOUBLE AS d,
      sum(p_retailprice)::DOUBLE AS u, sum(p_size * p_retailprice)::DOUBLE AS v, sum(p_size ** 2 * p_retailprice)::DOUBLE AS w FROM part),
    m AS (SELECT *, n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b) AS det FROM s)
    SELECT 0::INT AS power, round((u * (b * d - c * c) - a * (v * d - c * w) + b * (v * c - b * w)) / det, 5) AS coefficient FROM m UNION ALL
    SELECT 1, round((n * (v * d - c * w) - u * (a * d - b * c) + b * (a * w - b * v)) / det, 5) FROM m UNION ALL
    SELECT 2, round((n * (b * w - c * v) - a * (a * w - b * v) + u * (a * c - b * b)) / det, 5) FROM m"""
)
def polynomial_fit(spark, sf):
    df = t(spark, sf, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    coefficients = stats.polynomial_fit(df, "x", "y", 2)
    return rounded(spark.createDataFrame(list(enumerate(map(float, coefficients))), "power int, coefficient double"), 5)


_LOG = "SELECT regr_slope(l_extendedprice, ln(l_quantity)) AS b, regr_intercept(l_extendedprice, ln(l_quantity)) AS a, regr_r2(l_extendedprice, ln(l_quantity)) AS r2, count(*) AS n, var_pop(l_extendedprice) AS v FROM lineitem"


@query(f"SELECT n, round(a, 4) AS intercept, round(b, 4) AS slope, round(r2, 6) AS r2, round(sqrt(v * (1 - r2)), 4) AS rmse FROM ({_LOG})")
def log_fit(spark, sf):
    found = stats.log_fit(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return found.select("n", F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round(F.sqrt("mse"), 4).alias("rmse"))


@query(
    f"""WITH p AS (SELECT p_partkey, a + b * ln(p_size * 100.0) AS s FROM part, ({_LOG}))
    SELECT p_partkey, floor(s / 86400)::BIGINT AS days, floor(s % 86400 / 3600)::BIGINT AS hours, floor(s % 3600 / 60)::BIGINT AS minutes FROM p"""
)
def extrapolated_durations(spark, sf):
    """The fitted line far outside of what it was fitted on, read as a duration."""
    fit = stats.log_fit(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    asked = t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100.0).alias("x"))
    return stats.duration_parts(stats.predict_log(asked, "x", fit, "s"), "s").select("p_partkey", "days", "hours", "minutes")


# ------------------------------------------------------------------ time series


def _series(spark, sf):
    return t(spark, sf, "events").select(F.col("user_id").alias("subject"), "ts", "value")


# sums of lagged products of each subject's series, and its autocorrelations up to three
_LAGGED_SQL = """e AS (SELECT user_id AS subject, value - avg(value) OVER s AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS no, count(*) OVER s AS n, max(value) OVER s > min(value) OVER s AS varies
      FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) WINDOW s AS (PARTITION BY user_id)),
    rr AS (SELECT a.subject, a.n, a.varies, a.no - b.no AS k, sum(a.d * b.d) AS r FROM e a JOIN e b ON a.subject = b.subject AND b.no <= a.no GROUP BY ALL),
    rho AS (SELECT subject, n, sum(r) FILTER (k = 1) / t AS r1, sum(r) FILTER (k = 2) / t AS r2, sum(r) FILTER (k = 3) / t AS r3
      FROM (SELECT *, CASE WHEN varies THEN sum(r) FILTER (k = 0) OVER (PARTITION BY subject) END AS t FROM rr) GROUP BY subject, n, t)"""
_KPSS_SQL = f"""{_LAGGED_SQL},
    f AS (SELECT subject, n, sum(r) FILTER (k = 0) AS total, 2.0 / n * coalesce(sum(k * r) FILTER (k <= floor(n ** (2.0 / 9))), 0) AS s1,
      sum(r) FILTER (k = 0) / n + 2.0 / n * coalesce(sum(r) FILTER (k BETWEEN 1 AND floor(n ** (2.0 / 9))), 0) AS s0 FROM rr WHERE n >= 3 GROUP BY subject, n, varies HAVING varies),
    g AS (SELECT *, CASE WHEN s0 = 0 THEN 0 ELSE least(floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)), n - 1) END AS lags FROM f),
    v AS (SELECT g.subject, lags, total + 2 * coalesce(sum(r * (1 - k / (lags + 1))) FILTER (k BETWEEN 1 AND lags), 0) AS long_run FROM g JOIN rr USING (subject) GROUP BY g.subject, lags, total),
    p AS (SELECT subject, sum(t * t) AS partial FROM (SELECT subject, sum(d) OVER (PARTITION BY subject ORDER BY no) AS t FROM e) GROUP BY subject),
    x AS (SELECT subject, lags, CASE WHEN long_run > 0 THEN partial / long_run END AS t FROM v JOIN p USING (subject)),
    kpss AS (SELECT i.subject, i.n, t / i.n AS statistic, lags,
      CASE WHEN t / i.n <= 0.347 THEN 0.1 WHEN t / i.n <= 0.463 THEN 0.1 - 0.05 * (t / i.n - 0.347) / (0.463 - 0.347) WHEN t / i.n <= 0.574 THEN 0.05 - 0.025 * (t / i.n - 0.463) / (0.574 - 0.463)
        WHEN t / i.n <= 0.739 THEN 0.025 - 0.015 * (t / i.n - 0.574) / (0.739 - 0.574) WHEN t IS NOT NULL THEN 0.01 END::DOUBLE AS p_value
      FROM (SELECT DISTINCT subject, n FROM e WHERE n >= 3) i LEFT JOIN x USING (subject))"""


@query()
def adf(spark, sf):
    return rounded(timeseries.adf_per_subject(_series(spark, sf), "subject", "ts", "value"))


@query(f"WITH {_KPSS_SQL} SELECT subject, n, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, lags::DOUBLE AS lags, p_value >= 0.05 AS stationary FROM kpss")
def kpss(spark, sf):
    return rounded(timeseries.kpss_per_subject(_series(spark, sf), "subject", "ts", "value"))


@query()
def ar_ma_orders(spark, sf):
    return timeseries.orders_per_subject(_series(spark, sf), "subject", "ts", "value")


@query(
    f"""WITH {_LAGGED_SQL}, q AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM rho WHERE n >= 10), w AS (SELECT *, r1 - p2 * r1 AS b1 FROM q)
    SELECT subject, n, round(r1, 6) AS pacf1, round(p2, 6) AS pacf2, round((r3 - b1 * r2 - p2 * r1) / (1 - b1 * r1 - p2 * r2), 6) AS pacf3 FROM w"""
)
def pacf(spark, sf):
    return rounded(timeseries.pacf_per_subject(_series(spark, sf), "subject", "ts", "value"))


@query(
    """WITH d AS (SELECT user_id AS subject, ts, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events),
    p AS (SELECT subject, d, d * lag(d, 1) OVER w AS p1, d * lag(d, 2) OVER w AS p2 FROM d WINDOW w AS (PARTITION BY subject ORDER BY ts))
    SELECT subject, count(*) AS n, round(sum(p1) / nullif(sum(d * d), 0), 5) AS acf1, round(sum(p2) / nullif(sum(d * d), 0), 5) AS acf2 FROM p GROUP BY subject HAVING sum(d * d) > 1e-9"""
)
def acf(spark, sf):
    out = timeseries.acf_columns(_series(spark, sf), "subject", "ts", "value", 2)
    varied = _series(spark, sf).groupBy("subject").agg((F.var_pop("value") * F.count("*")).alias("__v")).where("__v > 1e-9")
    return rounded(out.join(varied.drop("__v"), "subject", "left_semi"), 5)


@query("SELECT ts::DATE AS day, round(avg(value), 6) AS value FROM events GROUP BY 1")
def mean_series(spark, sf):
    return rounded(timeseries.mean_series(_series(spark, sf).withColumn("day", F.col("ts").cast("date")), "day", "value"))


@query(
    f"""WITH {_KPSS_SQL}, m AS (SELECT subject % 2 AS side, count(*) FILTER (p_value >= 0.05) * 100.0::DOUBLE / count(*) AS share FROM kpss GROUP BY 1),
    b AS (SELECT (SELECT share FROM m WHERE side = 0) AS a, (SELECT share FROM m WHERE side = 1) AS b)
    SELECT round(a, 6) AS real, round(b, 6) AS synthetic, CASE WHEN a < 50 AND b >= 50 THEN 'fail' WHEN abs(a - b) < 20 THEN 'pass' ELSE 'warning' END AS verdict FROM b"""
)
def stationarity_comparison(spark, sf):
    a, b = halves(_series(spark, sf), "subject")
    tests = [timeseries.kpss_per_subject(x, "subject", "ts", "value") for x in (a, b)]
    return rounded(timeseries.compare_stationarity(*tests))


@query()
def order_comparison(spark, sf):
    a, b = halves(_series(spark, sf), "subject")
    return timeseries.compare_orders(*[timeseries.orders_per_subject(x, "subject", "ts", "value") for x in (a, b)])


@query(
    f"""WITH {_LAGGED_SQL}, m AS (SELECT subject % 2 AS side, unnest([1, 2, 3]) AS k, unnest([avg(r1), avg(r2), avg(r3)]) AS v FROM rho GROUP BY 1),
    z AS (SELECT a.v AS a, b.v AS b FROM m a JOIN m b ON a.k = b.k AND a.side = 0 AND b.side = 1), o AS (SELECT avg((a - b) ** 2) AS mse, corr(a, b) AS r FROM z)
    SELECT round(mse, 6) AS mse, round(r, 6) AS r, mse < 0.05 AND r > 0.7 AS passed FROM o"""
)
def acf_comparison(spark, sf):
    a, b = halves(_series(spark, sf), "subject")
    return rounded(timeseries.compare_acf(*[timeseries.acf_columns(x, "subject", "ts", "value") for x in (a, b)]))


# -------------------------------------------------------------------- privacy


def _uniform(keys: str, salt: str) -> str:
    """SQL of the number in (0, 1) that seeded noise takes from a row's keys."""
    return f"(('0x' || substr(md5(concat_ws('|', {keys}, '42', '{salt}')), 1, 13))::BIGINT::DOUBLE + 0.5) * {2.0**-52!r}"


def _normal(keys: str, salt: str) -> str:
    return f"sqrt(-2 * ln({_uniform(keys, salt + 'u')})) * cos(2 * pi() * {_uniform(keys, salt + 'v')})"


@query(f"SELECT event_id, round(value - 100.0::DOUBLE * sign(u) * ln(1 - 2 * abs(u)), 6) AS value FROM (SELECT *, {_uniform('event_id', 'value')} - 0.5 AS u FROM events)")
def laplace_noise(spark, sf):
    df = t(spark, sf, "events").select("event_id", "value")
    return rounded(privacy.laplace_noise(df, {"value": 100.0}, 1.0, ["event_id"]))


@query(f"SELECT event_id, round(value + {privacy.gaussian_sigma(100.0, 1.0, 1e-5)!r} * {_normal('event_id', 'value')}, 6) AS value FROM events")
def gaussian_noise(spark, sf):
    df = t(spark, sf, "events").select("event_id", "value")
    return rounded(privacy.gaussian_noise(df, {"value": 100.0}, 1.0, 1e-5, ["event_id"]))


@query(
    f"""WITH e AS (SELECT user_id AS subject, event_id, ((value % 1.0) + 1.0) % 1.0 AS value, {_normal('user_id, event_id', 'value')} AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events),
    n AS (SELECT a.event_id, sum(0.7 ** (a.no - b.no) * b.z * CASE WHEN b.no = 1 THEN 0.1 ELSE 0.1 * sqrt(1 - 0.7 ** 2) END) AS noise FROM e a JOIN e b ON a.subject = b.subject AND b.no <= a.no GROUP BY 1)
    SELECT e.subject, e.event_id, round(greatest(least(value + noise, 1.0), 0.0)::DOUBLE, 6) AS value FROM e JOIN n USING (event_id)"""
)
def ar1_noise(spark, sf):
    df = t(spark, sf, "events").select(F.col("user_id").alias("subject"), "event_id", F.pmod(F.col("value"), F.lit(1.0)).alias("value"))
    return rounded(privacy.correlated_noise(df, "subject", "event_id", {"value": 0.1}))


@query(
    f"""WITH r AS (SELECT count(*) FILTER (WHERE price IS NULL)::DOUBLE / count(*) AS share FROM ({O}) WHERE row_id % 2 = 0), s AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 1)
    SELECT n, round_even(n * share, 0)::BIGINT AS missing FROM r, s"""
)
def inject_missing(spark, sf):
    real, synthetic = halves(order_visits(spark, sf), "row_id")
    full = synthetic.withColumn("price", F.coalesce("price", F.lit(0.0)))
    out = privacy.inject_missing(full, real, ["price"], "row_id")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("price").isNull()).alias("missing"))


def _residual_sides(spark, sf):
    e = t(spark, sf, "events").select(
        F.col("user_id").alias("subject"), (F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10).alias("day"), "value", (F.col("event_id") % 17).cast("double").alias("other")
    )
    return halves(e, "subject")


_NEIGHBOURS_SQL = """v AS (SELECT user_id AS subject, epoch_us(ts) / 8.64e10 AS day, value, (event_id % 17)::DOUBLE AS other FROM events),
    f AS (SELECT subject, arg_min(value, day) AS x, arg_min(other, day) AS y FROM v GROUP BY subject),
    m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM f WHERE subject % 2 = 0),
    z AS (SELECT subject, (x - mx) / sx AS x, (y - my) / sy AS y FROM f, m),
    near AS (SELECT a.subject, b.subject AS base FROM z a JOIN z b ON a.subject % 2 = 1 AND b.subject % 2 = 0
      QUALIFY row_number() OVER (PARTITION BY a.subject ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.subject) <= 3),
    w AS (SELECT near.subject, base, day FROM near JOIN v USING (subject)),
    p AS (SELECT w.*, v.day AS d0, v.value AS v0, v.other AS o0 FROM w ASOF LEFT JOIN v ON w.base = v.subject AND w.day >= v.day),
    q AS (SELECT p.*, v.day AS d1, v.value AS v1, v.other AS o1, (p.day - d0) / nullif(v.day - d0, 0) AS part FROM p ASOF LEFT JOIN v ON p.base = v.subject AND p.day <= v.day),
    near_mean AS (SELECT subject, day, avg(coalesce(v0 + part * (v1 - v0), v0, v1)) AS value, avg(coalesce(o0 + part * (o1 - o0), o0, o1)) AS other FROM q GROUP BY subject, day)"""


@query(
    f"WITH {_NEIGHBOURS_SQL} SELECT subject, round(day, 6) AS day, round(n.value - v.value, 6) AS value, round(n.other - v.other, 6) AS other FROM v JOIN near_mean n USING (subject, day)"
)
def knn_residuals(spark, sf):
    real, synthetic = _residual_sides(spark, sf)
    return rounded(privacy.neighbour_residuals(synthetic, real, "subject", "day", ["value", "other"]))


@query(
    f"""WITH {_NEIGHBOURS_SQL} SELECT subject, round(day, 6) AS day, round(v.value + coalesce(n.value - v.value, 0), 6) AS value, round(v.other + coalesce(n.other - v.other, 0), 6) AS other
    FROM v LEFT JOIN near_mean n USING (subject, day) WHERE subject % 2 = 1"""
)
def residual_correction(spark, sf):
    real, synthetic = _residual_sides(spark, sf)
    r = privacy.neighbour_residuals(synthetic, real, "subject", "day", ["value", "other"])
    return rounded(privacy.add_residuals(synthetic, r, "subject", "day", ["value", "other"]))


@query("SELECT o.event_id, round(value + coalesce(r, 0), 6) AS value FROM (SELECT event_id, user_id, value FROM events) o LEFT JOIN (SELECT event_id, value / 10 AS r FROM events WHERE event_id % 2 = 0) s ON s.event_id = o.event_id")
def add_residuals(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("subject"), "event_id", "value")
    r = e.where("event_id % 2 = 0").withColumn("value", F.col("value") / 10)
    return rounded(privacy.add_residuals(e, r, "subject", "event_id", ["value"]).select("event_id", "value"))


@query()
def residual_bootstrap(spark, sf):
    real, synthetic = _residual_sides(spark, sf)
    r = privacy.neighbour_residuals(synthetic, real, "subject", "day", ["value", "other"])
    return rounded(privacy.residual_bootstrap(r, real, "subject", "day", ["value"]))


@query(
    """WITH s AS (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey % 50 AS k FROM orders WHERE o_orderkey % 2 = 1), r AS (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey % 50 AS k FROM orders WHERE o_orderkey % 2 = 0)
    SELECT (SELECT count(*) FROM s) AS n_synthetic, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM r)) AS identical, round((SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM r))::DOUBLE / (SELECT count(*) FROM s), 6) AS share"""
)
def ims(spark, sf):
    o = t(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 50)
    return rounded(privacy.identical_share(*halves(o, "o_orderkey"), ["o_orderstatus", "o_orderpriority", "k"]))


def _distance(x: str, y: str) -> str:
    return "sqrt(" + " + ".join(f"({x}.e{i} - {y}.e{i}) ** 2" for i in range(len(FEATURES))) + ")"


@query(
    f"""WITH v AS (SELECT vec_id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(len(FEATURES)))} FROM embeddings),
    r AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 < floor((SELECT count(*) FROM v WHERE vec_id % 2 = 0) * 0.8) AS trains FROM v WHERE vec_id % 2 = 0),
    s AS (SELECT {", ".join(f"avg(e{i}) AS a{i}, stddev_pop(e{i}) AS s{i}" for i in range(len(FEATURES)))} FROM r WHERE trains),
    z AS (SELECT vec_id, {", ".join(f"(e{i} - a{i}) / s{i} AS e{i}" for i in range(len(FEATURES)))} FROM v, s),
    d AS (SELECT q.vec_id, min({_distance("q", "b")}) FILTER (WHERE trains) AS train, min({_distance("q", "b")}) FILTER (WHERE NOT trains) AS rest
      FROM z q, z b JOIN (SELECT vec_id, trains FROM r) r ON r.vec_id = b.vec_id WHERE q.vec_id % 2 = 1 GROUP BY 1)
    SELECT count(*) AS n, round(avg(train), 6) AS train_distance, round(avg(rest), 6) AS rest_distance, round(avg((train < rest)::INT), 6) AS ratio FROM d"""
)
def dcr_ratio(spark, sf):
    return rounded(privacy.closest_record_ratio(*halves(vectors(spark, sf), "vec_id"), FEATURES, "vec_id", order="vec_id"))


_G = f"""v AS (SELECT vec_id, label, {", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(len(FEATURES)))} FROM embeddings), g AS (SELECT {", ".join(f"max(e{i}) - min(e{i}) AS r{i}" for i in range(len(FEATURES)))} FROM v),
d AS (SELECT q.vec_id AS query_id, min(({" + ".join(f"abs(q.e{i} - b.e{i}) / r{i}" for i in range(len(FEATURES)))} + (q.label <> b.label)::INT) / {len(FEATURES) + 1}) AS d FROM v q, v b, g WHERE q.vec_id % 2 = 1 AND b.vec_id % 2 = 0 GROUP BY 1)"""


@query(f"WITH {_G} SELECT query_id, round(1 - d, 6) AS similarity FROM d")
def gower_maximum(spark, sf):
    base, queries = halves(vectors(spark, sf), "vec_id")
    return rounded(privacy.gower_maximum(queries, base, "vec_id", [*FEATURES, "label"], ["label"]))


def _most_similar(side: int, other: int) -> str:
    gaps = " + ".join(f"abs(q.e{i} - b.e{i}) / g.r{i}" for i in range(len(FEATURES)))
    ends = ", ".join(f"max(e{i}) - min(e{i}) AS r{i}" for i in range(len(FEATURES)))
    return f"""SELECT 1 - min(({gaps}) / {len(FEATURES)}) AS x FROM v q, v b, (SELECT {ends} FROM v WHERE vec_id % 2 IN ({side}, {other})) g
      WHERE q.vec_id % 2 = {side} AND b.vec_id % 2 = {other} AND q.vec_id <> b.vec_id GROUP BY q.vec_id"""


def _gap(a: str, b: str) -> str:
    return f"""(SELECT max(abs(c)) FROM (SELECT (sum(i) OVER w) / (SELECT count(*) FROM {a}) - (sum(j) OVER w) / (SELECT count(*) FROM {b}) AS c
      FROM (SELECT x, sum(i)::DOUBLE AS i, sum(j)::DOUBLE AS j FROM (SELECT x, 1 AS i, 0 AS j FROM {a} UNION ALL SELECT x, 0, 1 FROM {b}) GROUP BY x) WINDOW w AS (ORDER BY x)))"""


@query(
    f"""WITH v AS (SELECT vec_id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(len(FEATURES)))} FROM embeddings),
    rr AS MATERIALIZED ({_most_similar(0, 0)}), ss AS MATERIALIZED ({_most_similar(1, 1)}), c AS MATERIALIZED ({_most_similar(1, 0)})
    SELECT (SELECT round(avg(x), 6) FROM rr) AS within_real, (SELECT round(avg(x), 6) FROM ss) AS within_synthetic, (SELECT round(avg(x), 6) FROM c) AS across,
    round({_gap("rr", "ss")}, 6) AS ks_synthetic, round({_gap("rr", "c")}, 6) AS ks_across, (SELECT round((SELECT avg(x) FROM c) / (SELECT avg(x) FROM rr), 6)) AS quality"""
)
def maximum_similarity(spark, sf):
    real, synthetic = halves(vectors(spark, sf), "vec_id")
    return rounded(privacy.maximum_similarity(real, synthetic, "vec_id", FEATURES))


# --------------------------------------------------------------- splits, models


@query(
    """WITH p AS (SELECT o_custkey, count(*) AS n_visits FROM orders GROUP BY 1), s AS (SELECT n_visits, count(*) AS n FROM p GROUP BY 1)
    SELECT n_visits, 'train' AS part, floor(n * 0.8)::BIGINT AS subjects FROM s WHERE floor(n * 0.8) > 0 UNION ALL SELECT n_visits, 'validation', n - floor(n * 0.8)::BIGINT FROM s WHERE n - floor(n * 0.8) > 0"""
)
def stratified_split(spark, sf):
    parts = splitting.stratified_subjects(order_visits(spark, sf), "subject", 0.8)
    return parts.groupBy("n_visits", "part").agg(F.count("*").alias("subjects"))


@query("SELECT count(DISTINCT o_custkey) AS subjects, 5::BIGINT AS folds FROM orders")
def kfold(spark, sf):
    f = splitting.fold_of(order_visits(spark, sf), "subject", 5).groupBy("subject").agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
    return f.where("a = b").agg(F.count("*").alias("subjects"), F.countDistinct("a").alias("folds"))


@query("SELECT 'O' AS status, count(DISTINCT o_custkey) AS subjects FROM orders WHERE o_orderstatus = 'O' HAVING count(DISTINCT o_custkey) >= 10")
def relax_conditions(spark, sf):
    run, n = splitting.relax_conditions(order_visits(spark, sf), "subject", [("status", "O"), ("code", "none")])
    return spark.createDataFrame([(run[0][1], n)], "status string, subjects long")


@query("SELECT o_custkey AS subject, last + k * 30.0::DOUBLE AS day FROM (SELECT o_custkey, max(date_diff('day', DATE '1990-01-01', o_orderdate::DATE))::DOUBLE AS last FROM orders GROUP BY 1), (VALUES (1), (2), (3)) t(k)")
def prediction_grid(spark, sf):
    df = t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("day"))
    return course.prediction_grid(df, "subject", "day", 3, 30.0)


_COURSE = {"memory": {"g": 2.0, "v0": 0.05}, "function": {"g": 5.0, "v0": 0.02}}


@query(
    "SELECT event_id, " + ", ".join(f"round(1 / (1 + {p['g']} * exp(-({p['v0'] * (1 + p['g']) ** 2 / p['g']} * (exp((user_id % 7) / 10.0 - 0.3) * (value - (user_id % 5)))))), 6) AS {f}" for f, p in _COURSE.items()) + " FROM events"
)
def course_scoring(spark, sf):
    e = t(spark, sf, "events").select("event_id", "value", ((F.col("user_id") % 7) / 10.0 - 0.3).alias("xi"), (F.col("user_id") % 5).alias("tau"))
    return rounded(course.score(e, "value", "xi", "tau", _COURSE).select("event_id", *_COURSE))


@query(
    """WITH e AS (SELECT value, (user_id % 7) / 10.0 - 0.3 AS xi, user_id % 5 AS tau FROM events), p AS (SELECT exp(xi) * (value - tau) + (SELECT avg(tau) FROM e) AS psi FROM e)
    SELECT floor(quantile_cont(psi, 0.01))::BIGINT - 5 AS low, ceil(quantile_cont(psi, 0.99))::BIGINT + 5 AS high FROM p"""
)
def psi_bounds(spark, sf):
    e = t(spark, sf, "events").select("value", ((F.col("user_id") % 7) / 10.0 - 0.3).alias("xi"), (F.col("user_id") % 5).cast("double").alias("tau"))
    return course.age_bounds(e, "value", "xi", "tau")


_PLANTED = {"a": {"g": 2.0, "v0": 0.02}, "b": {"g": 0.5, "v0": 0.03}, "c": {"g": 1.0, "v0": 0.05}}


def _planted(spark, sf):
    """Each user's events as visits at an age, with values of the course for parameters that its id gives."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("subject"), (40 + F.dayofyear("ts") / 6.0 + F.hour("ts")).alias("age"))
    e = e.withColumns({"xi": (F.col("subject") % 7 - 3) / 10.0, "tau": 65.0 + F.col("subject") % 11})
    return course.score(e, "age", "xi", "tau", _PLANTED)


@query(
    """WITH u AS (SELECT user_id AS subject, count(*) AS n FROM events GROUP BY ALL HAVING count(DISTINCT ts) >= 4)
    SELECT subject, n * 3 AS n, (subject % 7 - 3) / 10.0::DOUBLE AS xi, (65 + subject % 11)::DOUBLE AS tau FROM u"""
)
def individual_parameters(spark, sf):
    """Planted parameters are found again, to a tenth and a year."""
    rows = _planted(spark, sf)
    many = t(spark, sf, "events").groupBy(F.col("user_id").alias("subject")).agg(F.count_distinct("ts").alias("k")).where("k >= 4")
    found = course.individual_parameters(rows.join(many, "subject", "left_semi"), "subject", "age", _PLANTED, 70.0, 20.0, 5.0, 1e-3)
    return found.select("subject", "n", F.round("xi", 1).alias("xi"), F.round("tau", 0).alias("tau"))


@query(
    """WITH p AS (SELECT DISTINCT user_id AS s, (user_id % 7 - 3) / 10.0 AS xi, 65.0 + user_id % 11 AS tau FROM events),
    l AS (SELECT 'xi' AS variable, xi::DOUBLE AS v, s % 2 AS side FROM p UNION ALL SELECT 'tau', tau::DOUBLE, s % 2 FROM p),
    n AS (SELECT variable, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1, avg(v) FILTER (WHERE side = 0) AS mean_real, avg(v) FILTER (WHERE side = 1) AS mean_synthetic FROM l GROUP BY variable),
    c AS (SELECT variable, v, sum(sum(1 - side)) OVER w AS a, sum(sum(side)) OVER w AS b FROM l GROUP BY variable, v WINDOW w AS (PARTITION BY variable ORDER BY v))
    SELECT variable, round(max(abs(a / n0::DOUBLE - b / n1::DOUBLE)), 6) AS statistic, round(any_value(mean_real), 6) AS mean_real, round(any_value(mean_synthetic), 6) AS mean_synthetic FROM c JOIN n USING (variable) GROUP BY variable"""
)
def parameter_comparison(spark, sf):
    """Individual parameters of two halves of the subjects against one another."""
    p = _planted(spark, sf).select("subject", "xi", "tau").distinct()
    found = course.compare_parameters(p.where("subject % 2 = 0"), p.where("subject % 2 = 1"))
    return rounded(found.select("variable", "statistic", "mean_real", "mean_synthetic"))
