"""Scans, catalogue, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.functions import scalars as X
from visitframe.operators import cleaning as C
from visitframe.plans.base import ORDER_VISITS_SQL, SHIP_VISITS_SQL, halves, order_visits, query, rounded, ship_visits, t
from visitframe.sources import catalog, files


@query("SELECT l_orderkey, l_linenumber, l_tax = 0 AS missing FROM lineitem")
def scan_nan_to_null(spark, sf):
    zero = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", zero.alias("x"))
    return files.nan_to_null(df).select("l_orderkey", "l_linenumber", F.col("x").isNull().alias("missing"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source = 'src3'")
def catalog_search(spark, sf):
    df = t(spark, sf, "documents").select("doc_id", "lang", "source", F.create_map(F.lit("level"), "lang", F.lit("file_code"), "source").alias("custom"))
    return df.where(catalog.predicate({"custom.level": "de", "custom.file_code": "src3"})).drop("custom")


@query("SELECT source, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY source")
def catalog_query_in(spark, sf):
    df = t(spark, sf, "documents").select("source", F.create_map(F.lit("level"), "lang").alias("custom"))
    return df.where(catalog.predicate({"custom.level": ["en", "fr"]})).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN contains(upper(source), 'SRC1') THEN 'SRC1' WHEN contains(upper(source), 'SRC') THEN 'SRC' END AS kind FROM documents")
def dataset_type_of_name(spark, sf):
    return t(spark, sf, "documents").select("doc_id", catalog.dataset_type_column(F.col("source"), ["SRC1", "SRC"]).alias("kind"))


@query("SELECT doc_id, lang || '_' || translate(source || '.v/1', './', '--') AS name FROM documents")
def combination_names(spark, sf):
    df = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("a"), F.concat("source", F.lit(".v/1")).alias("b"))
    return df.select("doc_id", catalog.combination_column(["b", "a"]).alias("name"))


@query(
    """WITH m AS (SELECT doc_id, url, n_name, row_number() OVER (PARTITION BY doc_id ORDER BY n_nationkey) AS no
    FROM (SELECT doc_id, lang || ' ' || upper(source) || ' ' || n.n_name AS url FROM documents, nation n WHERE n.n_nationkey = doc_id % 20)
    JOIN nation n2 ON contains(url, n2.n_name)) SELECT doc_id, url, n_name FROM m WHERE no = 1"""
)
def first_match_population(spark, sf):
    nation = t(spark, sf, "nation")
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 20).cast("int").alias("n_nationkey"))
    listing = docs.join(nation.select("n_nationkey", "n_name"), "n_nationkey").select(
        "doc_id", F.concat_ws(" ", "lang", F.upper("source"), "n_name").alias("url")
    )
    return catalog.first_match(listing, nation, "url", "n_name", ["n_nationkey"]).select("doc_id", "url", "n_name")


@query("SELECT 'o' || o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 100 NOT IN (4, 9) THEN o_totalprice END AS b FROM orders")
def unknown_to_null(spark, sf):
    k = F.col("o_orderkey")
    df = t(spark, sf, "orders").select(
        F.concat(F.lit("o"), k).alias("k"),
        F.when(k % 10 == 3, F.lit("unknown")).otherwise(F.col("o_orderpriority")).alias("a"),
        F.when(k % 100 == 4, F.lit(-4.0)).when(k % 100 == 9, F.lit(9999.0)).otherwise(F.col("o_totalprice")).alias("b"),
    )
    return C.replace_unknown(df)


@query(f"SELECT row_id, code, price, score FROM ({ORDER_VISITS_SQL}) WHERE code IS NOT NULL OR price IS NOT NULL OR score IS NOT NULL")
def drop_all_null(spark, sf):
    return C.drop_all_null(order_visits(spark, sf).select("row_id", "code", "price", "score"), ["code", "price", "score"])


@query(f"SELECT subject, visit, price, score FROM ({ORDER_VISITS_SQL}) WHERE price IS NOT NULL OR score IS NOT NULL")
def category_projection(spark, sf):
    return C.category_projection(order_visits(spark, sf), ["subject", "visit", "cohort"], ["price", "score", "absent"])


@query(f"SELECT row_id, status FROM ({ORDER_VISITS_SQL}) WHERE status = 'F'")
def status_filter(spark, sf):
    df = order_visits(spark, sf).withColumn("__s", F.when(F.col("status") == "F", " Complete ").otherwise("partial"))
    return C.complete_only(df, "__s").select("row_id", "status")


@query(f"""SELECT row_id, CASE WHEN row_id % 3 = 1 THEN NULL ELSE price END AS price, score FROM ({ORDER_VISITS_SQL}) WHERE row_id % 3 <> 0 AND row_id % 11 <> 0""")
def qc_filter(spark, sf):
    k = F.col("row_id")
    q = F.when(k % 11 == 0, F.lit(None)).when(k % 3 == 0, "Fail").when(k % 3 == 1, "Hippocampus only").otherwise("Pass")
    df = order_visits(spark, sf).withColumn("q", q)
    return C.quality_filter(df, "q", ["price", "score"], ["score"]).select("row_id", "price", "score")


@query(f"SELECT row_id FROM ({ORDER_VISITS_SQL}) WHERE subject IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def multi_visit_subjects(spark, sf):
    return C.several_visits(order_visits(spark, sf), "subject").select("row_id")


@query(f"SELECT row_id FROM ({ORDER_VISITS_SQL}) WHERE visit IS NOT NULL OR (price IS NOT NULL)::INT + (score IS NOT NULL)::INT + (code IS NOT NULL)::INT >= 3")
def min_valid_measures(spark, sf):
    return C.enough_measures(order_visits(spark, sf), "visit", ["price", "score", "code"]).select("row_id")


@query(
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice BETWEEN 50000 AND 200000)
    SELECT o_orderkey FROM orders, b WHERE o_orderkey % 2 = 1 AND o_totalprice BETWEEN lo - (hi - lo) * 0.05 AND hi + (hi - lo) * 0.05"""
)
def range_filter_tolerance(spark, sf):
    real, synthetic = halves(t(spark, sf, "orders"), "o_orderkey")
    return C.within_range_of(synthetic, real.where(F.col("o_totalprice").between(50000, 200000)), "o_totalprice").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 100000")
def fixed_range(spark, sf):
    return C.in_range(t(spark, sf, "orders"), "o_totalprice", 1000, 100000).select("o_orderkey")


@query(f"SELECT count(*) AS n FROM ({ORDER_VISITS_SQL}) WHERE row_id <= (SELECT max(o_orderkey) FROM orders WHERE o_custkey = 7)")
def up_to_subject(spark, sf):
    return C.up_to_subject(order_visits(spark, sf), "subject", 7, "row_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def combination_filter(spark, sf):
    comb = {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "absent": "x", "o_custkey": None}
    return C.combination_filter(t(spark, sf, "orders"), comb).select("o_orderkey")


@query(f"SELECT least(count(*), 100) AS n FROM ({ORDER_VISITS_SQL})")
def deterministic_sample(spark, sf):
    return C.deterministic_sample(order_visits(spark, sf), 100, ["row_id"]).agg(F.count("*").alias("n"))


@query(
    f"""SELECT row_id, 'gross' AS method, amount AS value, tax AS rate FROM ({SHIP_VISITS_SQL}) WHERE amount IS NOT NULL OR tax IS NOT NULL
    UNION ALL SELECT row_id, 'count', quantity, discount FROM ({SHIP_VISITS_SQL}) WHERE quantity IS NOT NULL OR discount IS NOT NULL"""
)
def two_methods_long(spark, sf):
    methods = {"gross": {"value": "amount", "rate": "tax"}, "count": {"value": "quantity", "rate": "discount"}}
    return C.two_methods_long(ship_visits(spark, sf), ["row_id"], methods)


@query(
    f"""SELECT row_id, coalesce(CASE WHEN row_id % 5 IN (0, 1) THEN (row_id % 5)::INT END,
      CASE WHEN quantity IS NOT NULL AND flag <> 'N' THEN (quantity >= CASE flag WHEN 'A' THEN 25 ELSE 30 END)::INT END,
      CASE WHEN amount IS NOT NULL THEN (amount < 40000)::INT END) AS positive FROM ({SHIP_VISITS_SQL})"""
)
def hierarchy_flags(spark, sf):
    cutoffs = spark.createDataFrame(
        [("quantity", "A", 25.0), ("quantity", "unknown", 30.0), ("quantity", "n", None), ("amount", "unknown", 40000.0)], "marker string, method string, cutoff double"
    )
    df = ship_visits(spark, sf)
    for marker in ("quantity", "amount"):
        df = C.cutoff_lookup(df, cutoffs, marker, "flag", f"cut_{marker}")
    status = F.when(F.col("row_id") % 5 <= 1, F.col("row_id") % 5)
    rules = [(status, None, "="), (F.col("quantity"), F.col("cut_quantity"), ">="), (F.col("amount"), F.col("cut_amount"), "<")]
    return df.select("row_id", C.hierarchy_flag(rules).alias("positive"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 END AS gender,
      CASE p_size % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 0 END AS marital,
      CASE p_size % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS diagnosis,
      CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS ethnicity FROM part"""
)
def recode_maps(spark, sf):
    s = F.col("p_size")
    gender = F.when(s % 3 == 0, "female").when(s % 3 == 1, "male").otherwise("other")
    return t(spark, sf, "part").select(
        "p_partkey",
        X.recode(gender, X.GENDER).alias("gender"),
        X.recode(s % 5, X.MARITAL_CODES).alias("marital"),
        X.recode(s % 4, X.DIAGNOSIS_CODES).alias("diagnosis"),
        X.recode_contains(F.when(s % 2 == 0, "Hispanic").otherwise("Not known"), X.ETHNICITY).alias("ethnicity"),
    )


@query(
    """SELECT p_partkey, 'e' || (p_size % 3 + 2) || 'e' || (p_partkey % 3 + 2) AS genotype,
      ((p_size % 3 = 2)::INT + (p_partkey % 3 = 2)::INT) AS fours FROM part"""
)
def genotype(spark, sf):
    a, b = (F.col("p_size") % 3 + 2).cast("string"), (F.col("p_partkey") % 3 + 2).cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(a, F.lit("/"), b)).otherwise(F.concat(F.lit("e"), a, F.lit("e"), b))
    return t(spark, sf, "part").select("p_partkey", X.genotype(text).alias("genotype")).withColumn("fours", X.count_char(F.col("genotype"), "4"))


@query(
    """SELECT p_partkey, (p_size % 2)::INT AS a, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS n,
      CASE WHEN p_size <= 3 THEN p_size >> 1 END AS high, CASE WHEN p_size <= 3 THEN p_size & 1 END AS low,
      (CASE WHEN p_size % 2 = 1 THEN 'A+' ELSE 'A-' END) || (CASE WHEN p_size % 3 = 0 THEN 'N+' ELSE 'N-' END) AS profile FROM part"""
)
def profile_flags(spark, sf):
    s = F.col("p_size")
    text = F.concat(F.when(s % 2 == 1, "A+").otherwise("A-"), F.when(s % 3 == 0, "N+").when(s % 3 == 1, "N-").otherwise(""))
    high, low = X.two_bit(s.cast("string"))
    a, n = X.profile_flag(text, "A"), X.profile_flag(text, "N")
    return t(spark, sf, "part").select("p_partkey", a.alias("a"), n.alias("n"), high.alias("high"), low.alias("low"), X.profile_text({"A": a, "N": n}).alias("profile"))


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 6) AS ratio, round(l_quantity / nullif(l_tax, 0) * 100, 6) AS percent,
      round(l_quantity + l_tax, 6) AS total FROM lineitem"""
)
def ratios(spark, sf):
    df = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", X.safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"),
        X.percent_of(F.col("l_quantity"), F.col("l_tax")).alias("percent"), (F.col("l_quantity") + F.col("l_tax")).alias("total"),
    )
    return rounded(df)


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'elecsys' WHEN 1 THEN 'lumipulse' WHEN 2 THEN 'simoa' WHEN 3 THEN 'elecsys' ELSE 'other' END AS method FROM part"""
)
def method_normalize(spark, sf):
    s = F.col("p_size") % 5
    text = (
        F.when(s == 0, "  Electrochemiluminescence").when(s == 1, "LUMIPULSE  G1200").when(s == 2, "Single   Molecule Array ").when(s == 3, "Roche kit")
    )
    return t(spark, sf, "part").select("p_partkey", X.method_label(text, "other").alias("method"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN (event_id % 48)::INT WHEN 2 THEN (event_id % 7)::INT END AS months FROM events"""
)
def visit_codes(spark, sf):
    k = F.col("event_id")
    code = (
        F.when(k % 5 == 0, "BL").when(k % 5 == 1, F.concat(F.lit("m"), F.lpad((k % 48).cast("string"), 2, "0"))).when(k % 5 == 2, (k % 7).cast("string")).when(k % 5 == 3, "sc").otherwise("uns1")
    )
    return t(spark, sf, "events").select("event_id", X.visit_code_number(code).alias("months"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS day,
      round_even((date_part('year', o_orderdate) - 1950) + (date_part('month', o_orderdate) - 6 - CASE WHEN date_part('day', o_orderdate) < 15 THEN 1 ELSE 0 END) / 12.0, 0)::INT AS age
    FROM orders"""
)
def dates_and_ages(spark, sf):
    text = F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("not a date")
    return t(spark, sf, "orders").select(
        "o_orderkey", X.to_date(text).alias("day"), X.age_from_birth(F.col("o_orderdate").cast("date"), F.lit("1950-06-15").cast("date")).alias("age")
    )


@query("SELECT p_partkey, (p_size + 0.5)::DOUBLE AS number, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 0 END AS flag FROM part")
def numbers_from_text(spark, sf):
    s = F.col("p_size")
    flag = F.when(s % 3 == 0, " TRUE ").when(s % 3 == 1, "no").otherwise("maybe")
    return t(spark, sf, "part").select("p_partkey", X.first_number(F.concat((s + 0.5).cast("string"), F.lit(" Tesla"))).alias("number"), X.bool_like(flag).alias("flag"))


@query("SELECT p_partkey, (p_size // 6 * 6 + CASE WHEN p_size % 6 > 3 THEN 6 ELSE 0 END)::BIGINT AS step FROM part")
def step_grid(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.step_grid(F.col("p_size"), 6).alias("step"))
