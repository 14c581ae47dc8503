"""Conflicts, projections by dictionary, combinations, and functions that need no table of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.functions import scalars as X
from visitframe.operators import cleaning, conflicts, course, encoding, matching, ordering, privacy, profiling, stats, visits
from visitframe.plans.base import ORDER_VISITS_SQL as O
from visitframe.plans.base import halves, order_visits, query, rounded, t
from visitframe.sources import catalog

_CODES = """SELECT o_custkey AS subject, o_orderdate::DATE AS visit, o_orderkey AS row_id,
CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'bl' WHEN 2 THEN 'f' WHEN 3 THEN 'sc' WHEN 4 THEN 'm' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') END AS code,
CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'other' END AS status,
CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' WHEN 3 THEN 'P3' ELSE 'X' END AS phase,
CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders"""


def _coded(spark, sf):
    k = F.col("o_orderkey")
    code = F.when(k % 6 == 1, "bl").when(k % 6 == 2, "f").when(k % 6 == 3, "sc").when(k % 6 == 4, F.concat(F.lit("m"), F.lpad((k % 24).cast("string"), 2, "0")))
    status = F.when(k % 4 == 1, "complete").when(k % 4 == 2, "partial").when(k % 4 == 3, "other")
    phase = F.when(k % 5 == 1, "P1").when(k % 5 == 2, "P2").when(k % 5 == 3, "P3").when(k % 5 == 4, "X")
    return t(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderdate").cast("date").alias("visit"), k.alias("row_id"), code.alias("code"),
        status.alias("status"), phase.alias("phase"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
    )


@query(
    f"""WITH c AS (SELECT *, (code IS NOT NULL AND (code = 'bl' OR code LIKE 'm%')) AS ok FROM ({_CODES})),
    g AS (SELECT subject, arg_min(code, row_id) FILTER (WHERE code IS NOT NULL) AS any_code, arg_min(code, row_id) FILTER (WHERE ok) AS good FROM c GROUP BY subject),
    f AS (SELECT c.row_id, coalesce(c.code, g.any_code) AS code, g.good FROM c JOIN g ON c.subject = g.subject)
    SELECT row_id, CASE WHEN code = 'bl' OR code LIKE 'm%' THEN code ELSE coalesce(good, code) END AS code FROM f"""
)
def resolve_codes(spark, sf):
    return conflicts.resolve_codes(_coded(spark, sf), ["subject"], "code", ["row_id"]).select("row_id", "code")


@query(
    f"""WITH c AS (SELECT *, year(visit) AS y FROM ({_CODES})),
    g AS (SELECT subject, y, max(list_position(['P1', 'P2', 'P3'], phase)) FILTER (WHERE phase IN ('P1', 'P2', 'P3')) AS top,
      arg_min(phase, row_id) FILTER (WHERE phase IS NOT NULL) AS any_phase, arg_min(price, row_id) FILTER (WHERE price IS NOT NULL) AS any_price FROM c GROUP BY ALL),
    b AS (SELECT c.row_id, c.subject, c.y, CASE WHEN top IS NOT NULL THEN ['P1', 'P2', 'P3'][top] ELSE coalesce(phase, any_phase) END AS phase,
      coalesce(price, any_price) AS price, row_number() OVER (PARTITION BY c.subject, c.y ORDER BY (price IS NULL)::INT + (code IS NULL)::INT,
      CASE status WHEN 'complete' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, c.row_id) AS no FROM c JOIN g ON c.subject = g.subject AND c.y = g.y)
    SELECT row_id, phase, price FROM b WHERE no = 1"""
)
def drop_duplicate_rows(spark, sf):
    df = _coded(spark, sf).withColumn("y", F.year("visit"))
    out = conflicts.drop_duplicate_rows(df, ["subject", "y"], ["price", "code"], ["row_id"], {"phase": ["P1", "P2", "P3"]}, ["price"], "status")
    return out.select("row_id", "phase", "price")


@query(
    f"""WITH p AS (SELECT a.row_id, a.code AS c1, b.code AS c2, a.status AS s1, b.status AS s2, a.phase AS p1, b.phase AS p2, b.price FROM ({_CODES}) a JOIN ({_CODES}) b ON b.row_id = a.row_id + 1 WHERE a.row_id % 2 = 0)
    SELECT row_id, coalesce(c1, c2) AS code, CASE WHEN s1 = 'complete' OR s2 = 'complete' THEN 'complete' WHEN s1 = 'partial' OR s2 = 'partial' THEN 'partial' ELSE coalesce(s1, s2) END AS status,
    CASE WHEN coalesce(list_position(['P1', 'P2', 'P3'], p1), 0) + coalesce(list_position(['P1', 'P2', 'P3'], p2), 0) = 0 THEN coalesce(p1, p2)
      WHEN coalesce(list_position(['P1', 'P2', 'P3'], p1), 0) >= coalesce(list_position(['P1', 'P2', 'P3'], p2), 0) THEN p1 ELSE p2 END AS phase, price FROM p"""
)
def merge_paired_rows(spark, sf):
    c = _coded(spark, sf)
    a = c.where("row_id % 2 = 0").select("subject", "visit", "row_id", *[F.col(x).alias(f"{x}_1") for x in ("code", "status", "phase")])
    b = c.select((F.col("row_id") - 1).alias("row_id"), *[F.col(x).alias(f"{x}_2") for x in ("code", "status", "phase", "price")])
    rules = {"status": "status", "phase": ["P1", "P2", "P3"]}
    out = conflicts.merge_pairs(a.join(b, "row_id"), "subject", "visit", ["code", "status", "phase", "price"], rules)
    return out.select("row_id", "code", "status", "phase", "price")


_COMBINED = " UNION ALL ".join(
    f"""SELECT '{s}' AS combination, count(*) AS n_rows, count(DISTINCT coalesce(b.subject, a.subject)) AS n_subjects, count(b.price) AS n_price, count(a.total) AS n_total
    FROM (SELECT subject, visit, max(price) AS price FROM ({O}) WHERE visit IS NOT NULL AND status = '{s}' GROUP BY ALL) b
    FULL JOIN (SELECT subject, visit, sum(score) AS total FROM ({O}) WHERE visit IS NOT NULL GROUP BY ALL) a ON a.subject = b.subject AND a.visit = b.visit"""
    for s in ("F", "O", "P")
)


@query(_COMBINED)
def all_combinations(spark, sf):
    """The incremental merge for each status; visits of one day alone match."""
    v = order_visits(spark, sf).where("visit is not null")
    base = v.groupBy("subject", "visit", "status").agg(F.max("price").alias("price"), F.min("row_id").alias("row_id"))
    add = v.groupBy("subject", "visit").agg(F.sum("score").alias("total"), F.min("row_id").alias("row_id"))
    merged = matching.merge_combinations({"base": base, "add": add}, {"base": "status"}, "subject", "visit", code=None, measures=["price"], buffer_days=0)
    return merged.groupBy("combination").agg(
        F.count("*").alias("n_rows"), F.countDistinct("subject").alias("n_subjects"), F.count("price").alias("n_price"), F.count("total").alias("n_total")
    )


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey >= 0")
def drop_flagged(spark, sf):
    d = spark.createDataFrame([("c", "c_acctbal", "drop"), ("c", "c_custkey", "drop"), ("x", "c_name", "drop"), ("c", "c_phone", None)], "file_code string, variable_code string, flag string")
    df = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    out, rest = encoding.drop_flagged(df, d, "c", "flag", ["c_custkey"])
    return out.where(F.col("c_custkey") >= (0 if rest.count() == 2 else 1 << 60))


_PARTS = ["size", "retail_csf", "retail_pet", "brand"]


@query(
    """SELECT p_partkey, round(least(greatest((p_size - 1) / 49.0, 0), 1), 6) AS size, round(least(greatest((p_retailprice - 900) / 600.0, 0), 1), 6) AS retail_csf,
    round(least(greatest((p_retailprice - 800) / 1200.0, 0), 1), 6) AS retail_pet, p_brand AS brand FROM part"""
)
def present_settings(spark, sf):
    """The settings of the columns that are there, by the combination's methods, applied."""
    price = F.col("p_retailprice")
    df = t(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"), price.alias("retail_csf"), price.alias("retail_pet"), F.col("p_brand").alias("brand"))
    settings = {"size": (1, 50), "absent": (0, 1), "retail_csf": {"elecsys": (900, 1500), "unknown": (2, 3)}, "retail_pet": {"fbp": (4, 5), "unknown": (800, 2000)}, "brand": {"fbp": (7, 7)}}
    kept = encoding.present_settings(settings, df.columns, {"METHOD_CSF": "Elecsys", "METHOD_PET": None}, {"_csf": "METHOD_CSF", "_pet": "METHOD_PET"})
    names = encoding.present_columns(df.columns, {"a": ["size", "absent"], "b": ["retail_csf", "retail_pet", "brand"]})
    scaled = encoding.normalize_fixed(df, {c: (*kept[c], "increasing") for c in names if isinstance(kept.get(c), tuple)})
    return rounded(scaled.select("p_partkey", *names))


@query(
    """WITH v AS (SELECT o_custkey AS subject, o_orderdate::DATE AS d, o_orderkey AS row_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 6 AS months FROM orders),
    w AS (SELECT *, CASE WHEN months = 0 AND subject % 3 <> 0 THEN NULL ELSE d END AS visit, CASE WHEN months = 0 AND subject % 5 <> 0 THEN 60.0 + subject % 20 END AS age FROM v),
    b AS (SELECT subject, visit AS bl, age AS a FROM w WHERE months = 0),
    m AS (SELECT w.row_id, w.age, a, bl, w.months, (year(visit) - year(bl)) * 12 + month(visit) - month(bl) AS k, visit FROM w JOIN b ON b.subject = w.subject)
    SELECT row_id, round(coalesce(age, CASE WHEN bl IS NOT NULL THEN round_even(a + (k - (bl + to_months(k::INT) > visit)::INT) / 12.0, 1) ELSE a + months / 12.0 END)::DOUBLE, 6) AS age FROM m"""
)
def age_from_baseline(spark, sf):
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    v = t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("row_id"), ((no - 1) * 6).alias("months"))
    base = F.col("months") == 0
    df = v.withColumn("visit", F.when(base & (F.col("subject") % 3 != 0), None).otherwise(F.col("d"))).withColumn("age", F.when(base & (F.col("subject") % 5 != 0), 60.0 + F.col("subject") % 20))
    return rounded(visits.age_from_baseline(df, "subject", "visit", "months", "age", ["row_id"]).select("row_id", "age"))


@query(
    """SELECT * FROM (VALUES ('o_orderpriority', 'categorical', false), ('o_orderstatus', 'categorical', false), ('o_shippriority', 'numeric', false), ('o_totalprice', 'numeric', false), ('numbers', 'o_custkey,o_shippriority,o_totalprice', false)) t(variable, kind, warning)
    UNION ALL SELECT 'o_custkey', 'categorical', max(n) > 20 FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderkey % 2)"""
)
def feature_kinds(spark, sf):
    """Kinds of the features, and which of the categorical ones is a number with many values in the rows."""
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey", F.lit(0).alias("o_shippriority"))
    real, synthetic = halves(df, "o_orderkey")
    names = ["o_orderpriority", "o_orderstatus", "o_custkey", "o_shippriority", "o_totalprice"]
    numbers = ",".join(sorted(encoding.numeric_columns(df, ["o_orderkey"])))
    return encoding.feature_kinds(real, synthetic, names, names[:3]).union(spark.createDataFrame([("numbers", numbers, False)], "variable string, kind string, warning boolean"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS different FROM (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS b FROM orders) WHERE a IS NOT NULL AND b IS NOT NULL")
def label_disagreement(spark, sf):
    k = F.col("o_orderkey")
    df = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.when(k % 9 == 0, None).when(k % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("b"))
    return stats.label_disagreement(df, "a", "b")


@query()
def method_comparison(spark, sf):
    v = order_visits(spark, sf).where("price is not null and score is not null")
    df = v.select(F.col("price").alias("x"), (F.col("price") * (1 + (F.col("score") - 15) / 400)).alias("y"))
    return rounded(stats.compare_methods(df, "x", "y"), 4)


@query("SELECT * FROM (VALUES ('kind/a', 'dummy'), ('kind/b', 'dummy'), ('steps', 'ordinal'), ('known', 'ordinal'), ('price', 'continuous'), ('wide', 'continuous')) t(variable, class)")
def noise_classes(spark, sf):
    k = F.col("p_partkey")
    df = t(spark, sf, "part").select(
        k, F.lit(1.0).alias("time"), (k % 2).alias("kind/a"), F.when(k % 3 != 0, (k % 2).cast("double")).alias("kind/b"), (k % 7).cast("double").alias("steps"),
        (k % 19).alias("known"), F.col("p_retailprice").alias("price"), ((k % 5) * 10).alias("wide"),
    )
    return privacy.noise_classes(df, "p_partkey", "time", ["known"])


@query("SELECT n_nationkey, round(CASE WHEN n_nationkey / 25.0 > 0.5 THEN 2.0 / (n_nationkey / 25.0 / 0.5) ELSE 2.0 END::DOUBLE, 6) AS epsilon FROM nation")
def adaptive_budget(spark, sf):
    closeness = F.col("n_nationkey") / 25.0
    return rounded(t(spark, sf, "nation").select("n_nationkey", privacy.adaptive_epsilon(2.0, closeness, 0.5).alias("epsilon")))


@query()
def post_generation_noise(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("subject"), "event_id", F.pmod(F.col("value"), F.lit(1.0)).alias("value"), (F.col("event_id") % 3).alias("steps"))
    real, synthetic = halves(e, "event_id")
    return rounded(privacy.post_generation_noise(synthetic, real, "subject", "event_id", 0.8, epsilon=5.0))


@query(
    f"""WITH v AS (SELECT subject::VARCHAR AS ID, date_part('year', visit)::DOUBLE AS TIME, price, score, row_id FROM ({O}) WHERE visit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ID, TIME ORDER BY row_id) = 1)
    SELECT v.ID, v.TIME, v.price, c.score FROM (SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY ID) > 1) v JOIN (SELECT ID, arg_min_null(score, TIME) AS score FROM v GROUP BY ID) c ON c.ID = v.ID"""
)
def split_frame(spark, sf):
    df = order_visits(spark, sf).withColumn("year", F.year("visit").cast("double"))
    frame = encoding.model_frame(df, "subject", "year", ["price"], ["score"], order=["row_id"])
    predictors, cofactors = encoding.split_frame(frame, ["price"], ["score"])
    return predictors.join(cofactors, "ID")


@query("SELECT DISTINCT p_brand AS file_code, p_type AS variable_code, CASE WHEN p_brand LIKE '%1' THEN 7 END::BIGINT AS n FROM part")
def clone_dictionary(spark, sf):
    d = t(spark, sf, "part").select(F.col("p_brand").alias("file_code"), F.col("p_type").alias("variable_code"), F.lit(7).cast("long").alias("n")).distinct()
    return encoding.clone_dictionary(d, d.where(F.col("file_code").endswith("1")), ["n"])


@query(
    """SELECT event_id, CASE WHEN v - floor(v) <= 0.5 THEN floor(v) ELSE ceil(v) END::BIGINT AS scale, round(user_id % 10 / 10.0 * 50 + 100, 6)::DOUBLE AS volume, event_type AS kind, ['no', 'yes'][event_id % 2 + 1] AS flag
    FROM (SELECT *, 30 - (user_id % 31) / 30.0 * 30 AS v FROM events)"""
)
def reverse_all(spark, sf):
    e = t(spark, sf, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    coded = e.select(
        "event_id", ((F.col("user_id") % 31) / 30.0).alias("scale"), ((F.col("user_id") % 10) / 10.0).alias("volume"),
        *[(F.col("event_type") == k).cast("int").alias(f"kind/{k}") for k in kinds], (F.col("event_id") % 2).cast("int").alias("flag"),
    )
    out = encoding.reverse_all(coded, {"scale": (0, 30, "inverse")}, {"volume": (100, 150, "increasing")}, {"kind": "kind"}, {"flag": {0: "no", 1: "yes"}})
    return rounded(out.select("event_id", F.col("scale").cast("long").alias("scale"), "volume", "kind", "flag"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM (SELECT o_orderkey FROM orders LIMIT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0))")
def balance_sizes(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey")
    out = cleaning.balance_sizes(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"])
    return out.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids"))


@query("SELECT * FROM (VALUES ('extra_one', 'extra'), ('c_comment', 'missing'), ('c_nationkey', 'type')) t(\"column\", problem), (SELECT count(*) AS n_values FROM customer)")
def schema_check(spark, sf):
    """What differs between the columns of two tables, and how many values each such column holds."""
    real = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name", F.lit("c").alias("c_comment"))
    synthetic = real.select(F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_name", F.lit(1).alias("extra_one"))
    found = spark.createDataFrame(profiling.schema_check(real, synthetic), "column string, problem string")
    counts = [x.select([F.count(c).alias(c) for c in x.columns]).unpivot([], x.columns, "column", "n_values") for x in (real, synthetic)]
    return found.join(counts[0].union(counts[1]).groupBy("column").agg(F.max("n_values").alias("n_values")), "column")


@query(f"SELECT DISTINCT o.row_id FROM ({O}) o JOIN (SELECT o_custkey AS subject, l_shipdate::DATE AS visit FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s ON o.subject = s.subject AND o.visit = s.visit WHERE o.subject % 2 = 0")
def overlap_of_kinds(spark, sf):
    """The matcher's own kinds never overlap; exact matches of even subjects that are counted as buffered as well do."""
    from visitframe.plans.matching_queries import greedy

    found = greedy(spark, sf)
    again = found.where("kind = 'exact' and subject % 2 = 0").withColumn("kind", F.lit("buffer"))
    return matching.overlap_of_kinds(found.unionByName(again), "1")


@query(f"SELECT DISTINCT o.row_id FROM ({O}) o JOIN (SELECT o_custkey AS subject, l_shipdate::DATE AS visit FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s ON o.subject = s.subject AND o.visit = s.visit")
def matched_ids(spark, sf):
    from visitframe.plans.matching_queries import greedy

    return matching.matched_ids(greedy(spark, sf).where("kind = 'exact'"), "1")


_CURVE = {"memory": {"g": 2.0, "v0": 0.05}, "function": {"g": 5.0, "v0": 0.02}}


@query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, day(ts)::DOUBLE AS time, count(*) AS n, round(any_value(1 / (1 + {p['g']} * exp(-{p['v0'] * (1 + p['g']) ** 2 / p['g']} * (day(ts) - 15)))), 6) AS value FROM events GROUP BY day(ts)"
        for f, p in _CURVE.items()
    )
)
def population_curve(spark, sf):
    """The population's curve at the times that occur, with how many visits there are."""
    days = t(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("double").alias("time")).agg(F.count("*").alias("n"))
    at = course.score(days.withColumns({"xi": F.lit(0.0), "tau": F.lit(15.0)}), "time", "xi", "tau", _CURVE)
    return rounded(at.select("time", "n", *_CURVE).unpivot(["time", "n"], list(_CURVE), "feature", "value"))


@query(f"SELECT * FROM (VALUES ('cofactors', 'sex'), ('filters', 'status=F'), ('predictors', 'price,score'), ('settings', 'price')) t(what, value) UNION ALL SELECT 'rows', count(*)::VARCHAR FROM ({O}) WHERE status = 'F'")
def result_metadata(spark, sf):
    """What is recorded of a result: its variables, settings and filters, and how many rows these leave."""
    visits_table = order_visits(spark, sf)
    columns = visits_table.withColumn("sex", F.lit(1)).columns
    m = catalog.build_metadata(columns, {"price": [0, 1], "gone": [0, 1]}, ["price", "score", "gone"], ["sex", "code"], {"status": "F", "phase": None}, ["code"])
    rows = [("predictors", ",".join(m["predictors"])), ("cofactors", ",".join(m["cofactors"])), ("settings", ",".join(m["settings"])), ("filters", ",".join(f"{k}={v}" for k, v in m["filters"].items()))]
    n = cleaning.combination_filter(visits_table, m["filters"]).agg(F.lit("rows").alias("what"), F.count("*").cast("string").alias("value"))
    return spark.createDataFrame(rows, "what string, value string").unionByName(n)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS visit, (o_orderkey % 4)::VARCHAR AS version FROM orders")
def load_typed(spark, sf):
    k = F.col("o_orderkey")
    raw = t(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, "not a date").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("visit"), (k % 4).alias("version"))
    return catalog.load_typed({"orders": raw}, ["visit", "absent"], ["version"])["orders"]


@query(
    """WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), n AS (SELECT -n_nationkey - 1 AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation)
    SELECT k, place + CASE WHEN place >= 10 THEN (SELECT count(*) FROM n) ELSE 0 END AS place FROM o UNION ALL SELECT k, place + 10 FROM n"""
)
def splice_rows(spark, sf):
    n = t(spark, sf, "nation").select((-F.col("n_nationkey") - 1).alias("k"))
    return ordering.splice(t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), n.withColumn("__o", -F.col("k")), ["k"], ["__o"], 10, "place").select("k", "place")


@query("SELECT c_mktsegment, c_custkey, c_acctbal, c_name FROM customer")
def ordered_columns(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    out = ordering.order_columns(df, ["absent", "c_mktsegment"], last=["c_acctbal", "c_name"])
    assert out.columns == ["c_mktsegment", "c_custkey", "c_acctbal", "c_name"]
    return out


@query(
    """SELECT p_partkey, CASE WHEN p_size - 10 >= 0 THEN p_size - 10 END::INT AS education, CASE p_size % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 END::INT AS carrier,
    CASE p_size % 3 WHEN 1 THEN 'complete' WHEN 0 THEN 'partial' END AS quality, CASE WHEN p_size % 5 <> 0 THEN (p_size + p_partkey % 7)::DOUBLE END AS total FROM part"""
)
def clinical_recodes(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    group = F.when(s % 4 == 1, "no").when(s % 4 == 2, "yes").otherwise("maybe")
    return t(spark, sf, "part").select(
        "p_partkey", X.non_negative(s - 10).alias("education"), X.recode(group, {"no": 0, "yes": 1}).alias("carrier"),
        X.recode_text(s % 3, {1: "complete", 0: "partial"}).alias("quality"), X.both_sides(s.cast("double"), F.when(s % 5 != 0, (k % 7).cast("double"))).alias("total"),
    )
