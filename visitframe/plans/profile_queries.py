"""Profiles, aggregates and pre-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import profiling as P
from visitframe.plans.base import ORDER_VISITS_SQL as O
from visitframe.plans.base import SHIP_VISITS_SQL as S
from visitframe.plans.base import halves, order_visits, query, rounded, ship_visits, t

_NULLS = ["visit", "code", "price", "score"]


@query("SELECT o_custkey AS subject, count(*) AS n_visits FROM orders GROUP BY 1")
def visits_per_subject(spark, sf):
    return P.visits_per_subject(order_visits(spark, sf), "subject")


@query(
    f"""WITH v AS (SELECT subject, visit, row_id, price FROM ({O})), p AS (SELECT subject, count(*) AS n FROM v GROUP BY 1),
    u AS (SELECT unnest([count(*) FILTER (WHERE subject IS NULL), count(*) FILTER (WHERE visit IS NULL), count(*) FILTER (WHERE row_id IS NULL), count(*) FILTER (WHERE price IS NULL)]) * 100.0::DOUBLE / any_value((SELECT count(*) FROM v)) AS x FROM v)
    SELECT (SELECT count(*) FROM v) AS n_rows, 4::BIGINT AS n_columns, (SELECT min(visit) FROM v) AS date_min, (SELECT max(visit) FROM v) AS date_max,
      round((SELECT avg(x) FROM u), 6) AS null_mean, round((SELECT max(x) FROM u), 6) AS null_max, (SELECT count(*) FROM u WHERE x = 0) AS complete_columns, (SELECT count(*) FROM u WHERE x > 0) AS columns_with_null,
      count(*) AS n_subjects, min(n) AS visits_min, max(n) AS visits_max, round(avg(n), 6) AS visits_mean, round(quantile_cont(n, 0.5), 6) AS visits_median, round(stddev(n), 6) AS visits_std,
      round(quantile_cont(n, 0.25), 6) AS visits_q25, round(quantile_cont(n, 0.75), 6) AS visits_q75 FROM p"""
)
def merge_statistics(spark, sf):
    return rounded(P.merge_statistics(order_visits(spark, sf).select("subject", "visit", "row_id", "price"), "subject", "visit"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_percent FROM ({O})" for c in _NULLS))
def null_profile(spark, sf):
    return rounded(P.null_profile(order_visits(spark, sf), _NULLS))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS total, count({c}) AS valid, count(*) - count({c}) AS missing, min({c}) AS low, max({c}) AS high, '{k}' AS kind, CASE WHEN count({c}) / count(*) > 0.65 THEN 'keep' ELSE 'drop' END AS decision FROM ({O})"
        for c, k in (("code", "range"), ("status", "class"), ("priority", "class"))
    )
)
def column_profile(spark, sf):
    return P.column_profile(order_visits(spark, sf), ["code", "status", "priority"])


@query(
    f"""WITH p AS (SELECT subject, count(price) AS a, count(score) AS b FROM ({O}) GROUP BY 1)
    SELECT 'price' AS variable, count(*) FILTER (WHERE a > 0) AS subjects, count(*) FILTER (WHERE a > 1) AS subjects_multiple FROM p
    UNION ALL SELECT 'score', count(*) FILTER (WHERE b > 0), count(*) FILTER (WHERE b > 1) FROM p"""
)
def subjects_with_values(spark, sf):
    return P.subjects_with_values(order_visits(spark, sf), "subject", ["price", "score"])


@query(
    """WITH m AS (SELECT n_regionkey::VARCHAR AS file, CASE n_nationkey % 2 WHEN 0 THEN ['A', 'B'] ELSE ['B', 'C'] END AS lists FROM nation),
    g AS (SELECT file, list_distinct(list(lists)) AS all_lists FROM m GROUP BY 1),
    c AS (SELECT file, list_reduce(all_lists, lambda x, y: list_intersect(x, y)) AS common FROM g)
    SELECT file, array_to_string(list_sort(list_filter(['A', 'B', 'C'], lambda p: NOT list_contains(common, p))), ',') AS present FROM c"""
)
def present_populations(spark, sf):
    lists = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"), F.lit("C")))
    df = t(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("file"), lists.alias("lists"))
    return P.present_populations(df, "file", "lists", ["A", "B", "C"])


@query("SELECT 'o_orderpriority' AS variable, count(*) AS varying FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderpriority) <> max(o_orderpriority))")
def population_column(spark, sf):
    return P.population_column(t(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], ["URGENT"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.99), 6) AS p99 FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def percentiles(spark, sf):
    return rounded(P.percentiles(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(
    """SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean, round(stddev(l_quantity), 4) AS std, min(l_quantity) AS min, max(l_quantity) AS max,
    quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1"""
)
def group_describe(spark, sf):
    return P.describe(t(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", 4)


@query("SELECT p_brand AS brand, round(avg(p_retailprice), 6) AS price, max(p_size) AS largest, count(*) AS n FROM part GROUP BY 1")
def named_aggregates(spark, sf):
    return rounded(
        t(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(
            F.avg("p_retailprice").alias("price"), F.max("p_size").alias("largest"), F.count("*").alias("n")
        )
    )


@query("SELECT o_orderstatus AS status, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 6) AS \"1-URGENT\", round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 6) AS \"5-LOW\" FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def pivot_mean(spark, sf):
    df = t(spark, sf, "orders").withColumn("status", F.col("o_orderstatus"))
    return rounded(P.pivot(df.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")), ["status"], "o_orderpriority", ["1-URGENT", "5-LOW"], F.avg("o_totalprice")))


@query("SELECT o_custkey AS subject, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def pivot_first(spark, sf):
    df = t(spark, sf, "orders").withColumn("subject", F.col("o_custkey")).where("o_orderstatus in ('F', 'O')")
    return P.pivot(df, ["subject"], "o_orderstatus", ["F", "O"], F.min_by("o_totalprice", "o_orderkey"))


@query(
    """WITH l AS (SELECT l_orderkey AS visit, CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN 'MEDIAN' ELSE 'b' || l_linenumber END AS batch, l_quantity AS q, l_tax AS x FROM lineitem)
    SELECT visit, batch, round(q, 6) AS q, round(x, 6) AS x FROM l WHERE batch = 'MEDIAN'
    UNION ALL SELECT visit, 'MEDIAN_calculated', round(avg(q), 6), round(avg(x), 6) FROM l WHERE visit NOT IN (SELECT visit FROM l WHERE batch = 'MEDIAN') GROUP BY visit"""
)
def mean_row_without_median(spark, sf):
    batch = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 2 == 0), "MEDIAN").otherwise(F.concat(F.lit("b"), "l_linenumber"))
    df = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("visit"), batch.alias("batch"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("x"))
    return rounded(P.mean_where_no_median(df, ["visit"], "batch", ["q", "x"]))


@query(
    """WITH r AS (SELECT o_orderpriority AS class, count(*)::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS real_share FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    s AS (SELECT o_orderpriority AS class, count(*)::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1) AS synthetic_share FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT class, round(real_share, 6) AS real_share, round(synthetic_share, 6) AS synthetic_share, round(abs(coalesce(real_share, 0) - coalesce(synthetic_share, 0)), 6) AS difference FROM r FULL JOIN s USING (class)"""
)
def class_distribution_diff(spark, sf):
    return rounded(P.class_shares(*halves(t(spark, sf, "orders"), "o_orderkey"), "o_orderpriority"))


@query(
    """WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT min(o_totalprice) AS c, max(o_totalprice) AS d FROM orders WHERE o_orderkey % 2 = 1)
    SELECT 'o_totalprice' AS variable, a AS real_min, b AS real_max, c AS synthetic_min, d AS synthetic_max, c >= a - (b - a) * 0.2 AND d <= b + (b - a) * 0.2 AS inside FROM r, s"""
)
def range_check(spark, sf):
    return P.range_check(*halves(t(spark, sf, "orders"), "o_orderkey"), ["o_totalprice"])


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, round(a, 6) AS real_percent, round(b, 6) AS synthetic_percent, round(abs(a - b), 6) AS difference, abs(a - b) > 15 AS too_large
        FROM (SELECT count(*) FILTER (WHERE {c} IS NULL AND row_id % 2 = 0) * 100.0::DOUBLE / count(*) FILTER (WHERE row_id % 2 = 0) AS a, count(*) FILTER (WHERE {c} IS NULL AND row_id % 2 = 1) * 100.0::DOUBLE / count(*) FILTER (WHERE row_id % 2 = 1) AS b FROM ({O}))"""
        for c in ("price", "score")
    )
)
def null_rate_diff(spark, sf):
    return rounded(P.null_rate_difference(*halves(order_visits(spark, sf), "row_id"), ["price", "score"]))


@query(
    """WITH r AS (SELECT count(*) AS a, avg(n) AS b FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey)), s AS (SELECT count(*) AS c, avg(n) AS d FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey))
    SELECT a AS real_subjects, round(b, 6) AS real_visits, c AS synthetic_subjects, round(d, 6) AS synthetic_visits, round(abs(a - c)::DOUBLE / a, 6) AS subjects_difference, round(abs(b - d) / b, 6) AS visits_difference,
      abs(a - c)::DOUBLE / a <= 0.3 AS subjects_ok, abs(b - d) / b <= 0.4 AS visits_ok FROM r, s"""
)
def longitudinal_check(spark, sf):
    return rounded(P.longitudinal_check(*halves(order_visits(spark, sf), "row_id"), "subject"))


@query("SELECT CASE WHEN r < 0.3 THEN 'issue' WHEN r < 0.5 OR r > 2 THEN 'warning' ELSE 'pass' END AS verdict, round(r, 6) AS ratio FROM (SELECT count(*) FILTER (WHERE o_orderkey % 3 = 1)::DOUBLE / count(*) FILTER (WHERE o_orderkey % 3 <> 1) AS r FROM orders)")
def size_ratio(spark, sf):
    k = F.col("o_orderkey") % 3 == 1
    r = t(spark, sf, "orders").agg((F.count_if(k) / F.count_if(~k)).alias("ratio"))
    return rounded(r.select(P.size_verdict(F.col("ratio")).alias("verdict"), "ratio"))


@query("SELECT o_custkey AS subject, o_orderstatus AS status FROM orders GROUP BY ALL")
def distinct_combinations(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("status")).distinct()


@query(f"SELECT row_id, round((coalesce(quantity, 0) + coalesce(amount, 0) + coalesce(tax, 0)) / nullif((quantity IS NOT NULL)::INT + (amount IS NOT NULL)::INT + (tax IS NOT NULL)::INT, 0), 6) AS mean FROM ({S})")
def row_mean(spark, sf):
    return rounded(ship_visits(spark, sf).select("row_id", P.row_mean(["quantity", "amount", "tax"]).alias("mean")))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ({S}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in (("quantity", "amount"), ("quantity", "tax"), ("amount", "tax"))))
def corr_matrix(spark, sf):
    return rounded(P.correlations(ship_visits(spark, sf), ["quantity", "amount", "tax"]))


@query(f"SELECT flag, round(avg(abs(quantity - amount / 1500)), 6) AS mae, round(1.96 * stddev_pop(abs(quantity - amount / 1500)) / sqrt(count(quantity - amount)), 6) AS half_width, count(quantity - amount) AS n FROM ({S}) GROUP BY flag")
def mae_ci(spark, sf):
    df = ship_visits(spark, sf).withColumn("predicted", F.col("amount") / 1500)
    return rounded(P.mae_with_interval(df, "quantity", "predicted", ["flag"]))


@query("SELECT o_custkey AS subject, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def varying_within_subject(spark, sf):
    return P.varying_within_subject(order_visits(spark, sf), "subject", "status")


@query("(SELECT 'high' AS side, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL (SELECT 'low', c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)")
def top5_low_high(spark, sf):
    c = t(spark, sf, "customer")
    high, low = P.top(c, "c_acctbal", ties=["c_custkey"]), P.top(c, "c_acctbal", largest=False, ties=["c_custkey"])
    return high.select(F.lit("high").alias("side"), "c_custkey").unionByName(low.select(F.lit("low").alias("side"), "c_custkey"))


@query("SELECT (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1) AS lowest, (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS highest")
def argmin_argmax(spark, sf):
    return P.extremes(t(spark, sf, "customer"), "c_custkey", "c_acctbal")


@query(f"SELECT variable, nulls FROM (SELECT unnest(['visit', 'code', 'price', 'score']) AS variable, unnest([count(*) - count(visit), count(*) - count(code), count(*) - count(price), count(*) - count(score)]) AS nulls FROM ({O})) ORDER BY nulls DESC LIMIT 2")
def most_null_columns(spark, sf):
    return P.ordered_by_nulls(order_visits(spark, sf).select(*_NULLS)).select("variable", "nulls").limit(2)


@query("SELECT l_quantity AS value, round(sum(count(*)) OVER (ORDER BY l_quantity)::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_quantity")
def empirical_distribution(spark, sf):
    return rounded(P.ecdf(t(spark, sf, "lineitem"), "l_quantity"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders")
def global_order(spark, sf):
    from visitframe.operators.ordering import global_index

    return global_index(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "place")
