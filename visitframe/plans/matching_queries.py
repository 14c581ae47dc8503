"""Joins and matching of visit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.operators import matching as M
from visitframe.operators import profiling as P
from visitframe.operators import visits as V
from visitframe.plans.base import ORDER_VISITS_SQL as O
from visitframe.plans.base import SHIP_VISITS_SQL as S
from visitframe.plans.base import order_visits, query, rounded, ship_visits, t
from visitframe.session import materialize


def _base(spark, sf):
    return V.dedup_visits(order_visits(spark, sf), "subject", "visit", "code", ["price", "score", "code"], ["row_id"], least=2)


def _add(spark, sf):
    return V.best_row(ship_visits(spark, sf), ["subject", "visit"], ["quantity", "amount"], ["row_id"])


@query(f"SELECT o.row_id AS row_id_1, s.row_id AS row_id_2 FROM ({O}) o JOIN ({S}) s ON o.subject = s.subject AND o.visit = s.visit")
def exact_visit_join(spark, sf):
    joined = M.exact_join(order_visits(spark, sf), ship_visits(spark, sf), ["subject", "visit"])
    return joined.select("row_id_1", "row_id_2")


@query(
    f"""SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.code, b.code) AS code, a.n AS orders, b.n AS ships
    FROM (SELECT subject, code, count(*) AS n FROM ({O}) GROUP BY ALL) a FULL JOIN (SELECT subject, code, count(*) AS n FROM ({S}) GROUP BY ALL) b
    ON a.subject IS NOT DISTINCT FROM b.subject AND a.code IS NOT DISTINCT FROM b.code"""
)
def outer_natural_merge(spark, sf):
    a = order_visits(spark, sf).groupBy("subject", "code").agg(F.count("*").alias("orders"))
    b = ship_visits(spark, sf).groupBy("subject", "code").agg(F.count("*").alias("ships"))
    return M.outer_natural(a, b)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_indicator(spark, sf):
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def semi_split(spark, sf):
    from visitframe.operators.cleaning import members_of

    ids = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return members_of(t(spark, sf, "customer"), ids, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"SELECT s.row_id FROM ({S}) s LEFT JOIN (SELECT DISTINCT subject AS sj, visit AS v FROM ({O})) o ON s.subject = sj AND s.visit = v WHERE sj IS NULL AND s.quantity > 49")
def left_join_context(spark, sf):
    seen = order_visits(spark, sf).select("subject", "visit").distinct().withColumn("seen", F.lit(1))
    joined = M.exact_join(ship_visits(spark, sf), seen, ["subject", "visit"], "left")
    return joined.where("seen is null and quantity > 49").select("row_id")


_PAIRS = f"""WITH o AS (SELECT * FROM ({O})), s AS (SELECT * FROM ({S})),
x AS (SELECT DISTINCT o.subject, o.visit FROM o JOIN s ON o.subject = s.subject AND o.visit = s.visit)
SELECT o.row_id AS id1, s.row_id AS id2 FROM o JOIN s ON o.subject = s.subject AND abs(date_diff('day', o.visit, s.visit)) <= 80
WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.subject = o.subject AND x.visit = o.visit) AND NOT EXISTS (SELECT 1 FROM x WHERE x.subject = s.subject AND x.visit = s.visit)"""


def _sides(spark, sf):
    a = order_visits(spark, sf).select("subject", F.col("visit").alias("d1"), F.col("row_id").alias("id1"), F.col("code").alias("code1"))
    b = ship_visits(spark, sf).select("subject", F.col("visit").alias("d2"), F.col("row_id").alias("id2"), F.col("code").alias("code2"))
    return a, b


@query(_PAIRS)
def buffer_candidates(spark, sf):
    return M.buffered_pairs(*_sides(spark, sf), "subject", "d1", "d2", 80).select("id1", "id2")


@query(_PAIRS + " AND o.code IS NOT DISTINCT FROM s.code")
def buffer_with_extra(spark, sf):
    return M.buffered_pairs(*_sides(spark, sf), "subject", "d1", "d2", 80, [("code1", "code2")]).select("id1", "id2")


def greedy(spark, sf):
    return M.match_visits(order_visits(spark, sf), ship_visits(spark, sf), "subject", "visit")


@query()
def greedy_visit_match(spark, sf):
    out = M.cardinality(greedy(spark, sf))
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("ids1", "ids2")})


_EXACT = f"""SELECT o.subject, o.visit, o.n1, s.n2 FROM (SELECT subject, visit, count(*) AS n1 FROM ({O}) GROUP BY ALL) o
JOIN (SELECT subject, visit, count(*) AS n2 FROM ({S}) GROUP BY ALL) s ON o.subject = s.subject AND o.visit = s.visit"""


@query(f"SELECT CASE WHEN n1 = 1 THEN '1' ELSE 'N' END || ':' || CASE WHEN n2 = 1 THEN '1' ELSE 'N' END AS cardinality, count(*) AS n FROM ({_EXACT}) GROUP BY 1")
def match_cardinality(spark, sf):
    exact = M.cardinality(greedy(spark, sf).where("kind = 'exact'"))
    return exact.groupBy("cardinality").agg(F.count("*").alias("n"))


@query(
    f"""WITH p AS ({_PAIRS.replace('SELECT o.row_id AS id1, s.row_id AS id2', 'SELECT o.row_id AS id1, s.row_id AS id2, o.code AS c1, s.code AS c2, date_diff(' + "'day'" + ', o.visit, s.visit) AS gap')})
    SELECT id1, id2, CASE WHEN NOT coalesce(c1 = c2, false) AND coalesce(contains(c1, 'm'), false) AND coalesce(contains(c2, 'm'), false) THEN 'manual'
      WHEN coalesce(c1 = c2, false) OR abs(gap) < 30 THEN 'merge' ELSE 'skip' END AS decision FROM p"""
)
def buffer_decision(spark, sf):
    p = M.buffered_pairs(*_sides(spark, sf), "subject", "d1", "d2", 80)
    return p.select("id1", "id2", M.decide_buffered(F.col("code1"), F.col("code2"), F.datediff("d1", "d2")).alias("decision"))


@query(
    f"""WITH p AS ({_PAIRS.replace('SELECT o.row_id AS id1, s.row_id AS id2', 'SELECT o.row_id AS id1, s.row_id AS id2, o.visit AS d1')}), f AS (SELECT id2, arg_min(d1, id1) AS d FROM p GROUP BY id2)
    SELECT s.row_id, coalesce(f.d, s.visit) AS visit, s.visit AS was FROM ({S}) s LEFT JOIN f ON f.id2 = s.row_id"""
)
def aligned_dates(spark, sf):
    """Shipments with the date of the order within 80 days that comes first by its id."""
    a, b = _sides(spark, sf)
    links = M.buffered_pairs(a, b, "subject", "d1", "d2", 80).select("id1", "id2", "d1")
    base, add = a.select(F.col("id1").alias("row_id"), F.col("d1").alias("visit")), b.select(F.col("id2").alias("row_id"), F.col("d2").alias("visit"), F.col("d2").alias("was"))
    return M.align_dates(base, add, links, "visit", base_date="d1").select("row_id", "visit", "was")


@query()
def merge_visits(spark, sf):
    """Orders and shipments of a customer as one visit table."""
    add = _add(spark, sf).drop("flag")
    return M.merge_pair(_base(spark, sf), add, "subject", "visit", "code", ["price", "score"], status="status")


@query()
def merge_two_sources(spark, sf):
    """The flagship: statistics of the merged visit table."""
    return rounded(P.merge_statistics(merge_visits(spark, sf), "subject", "visit"))


@query()
def merge_three_sources(spark, sf):
    events = V.best_row(
        t(spark, sf, "events").select(
            F.col("user_id").alias("subject"), F.add_months(F.col("ts").cast("date"), -300).alias("visit"), F.col("event_id").alias("row_id"), F.lit("m12").alias("code"), F.col("value").alias("reading")
        ),
        ["subject", "visit"], ["reading"], ["row_id"],
    )
    tables = [_base(spark, sf), _add(spark, sf).drop("flag"), events]
    return M.merge_all(tables, subject="subject", date="visit", code="code", measures=["price", "score"], status="status").drop("row_id")


@query(
    f"""WITH e AS (SELECT user_id AS subject, ts, event_id, value FROM events WHERE event_id % 3 <> 0), r AS (SELECT user_id AS subject, ts, value FROM events WHERE event_id % 3 = 0),
    c AS (SELECT e.event_id, r.value, r.ts, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(r.ts) - epoch_us(e.ts)), r.ts) AS no FROM e JOIN r ON r.subject = e.subject)
    SELECT e.event_id, c.value AS reading, c.ts AS reading_time FROM e LEFT JOIN c ON c.event_id = e.event_id AND c.no = 1"""
)
def asof_nearest(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", F.col("value").alias("reading"))
    left, right = e.where("event_id % 3 <> 0").drop("reading"), e.where("event_id % 3 = 0")
    return M.as_of_nearest(left, right, "subject", "ts", "reading").select("event_id", "reading", "reading_time")


@query(
    """WITH e AS (SELECT user_id AS subject, ts, event_id FROM events WHERE event_id % 3 <> 0), r AS (SELECT user_id AS subject, ts, value FROM events WHERE event_id % 3 = 0)
    SELECT e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(r.ts) <= 86400000000 THEN r.value END AS reading FROM e ASOF LEFT JOIN r ON e.subject = r.subject AND e.ts >= r.ts"""
)
def asof_backward_tolerance(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", F.col("value").alias("reading"))
    left, right = e.where("event_id % 3 <> 0").drop("reading"), e.where("event_id % 3 = 0")
    return M.as_of_nearest(left, right, "subject", "ts", "reading", tolerance=86_400_000_000, direction="backward").select("event_id", "reading")


#: All components of the vectors of `embeddings`.
FEATURES = [f"e{i}" for i in range(64)]


def vectors(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(FEATURES)])


@query(
    f"""WITH v AS (SELECT vec_id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(len(FEATURES)))} FROM embeddings),
    s AS (SELECT {", ".join(f"avg(e{i}) AS a{i}, stddev_pop(e{i}) AS s{i}" for i in range(len(FEATURES)))} FROM v),
    z AS (SELECT vec_id, {", ".join(f"(e{i} - a{i}) / s{i} AS e{i}" for i in range(len(FEATURES)))} FROM v, s),
    d AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, sqrt({" + ".join(f"(q.e{i} - b.e{i}) ** 2" for i in range(len(FEATURES)))}) AS distance FROM z q, z b WHERE q.vec_id % 5 = 0 AND b.vec_id % 5 <> 0)
    SELECT query_id, round(distance, 6) AS distance, no::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS no FROM d) WHERE no <= 3"""
)
def knn_embeddings(spark, sf):
    from visitframe.operators.encoding import standardize

    z = materialize(standardize(vectors(spark, sf), FEATURES))
    near = M.blocked_nearest(z.where("vec_id % 5 = 0"), z.where("vec_id % 5 <> 0"), "vec_id", FEATURES, 3)
    return rounded(near.select("query_id", "distance", "rank"))


@query("SELECT a.o_orderstatus AS status, b.o_orderpriority AS priority FROM (SELECT DISTINCT o_orderstatus FROM orders) a, (SELECT DISTINCT o_orderpriority FROM orders) b")
def filter_combinations(spark, sf):
    o = t(spark, sf, "orders")
    status, priority = o.select(F.col("o_orderstatus").alias("status")).distinct(), o.select(F.col("o_orderpriority").alias("priority")).distinct()
    return status.crossJoin(priority)  # the product of two value lists is the result


@query("SELECT 'o_orderstatus' AS filter, o_orderstatus AS value FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY ALL")
def filter_values(spark, sf):
    return P.distinct_values(t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"o_orderstatus": ["F", "O"]})


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT DISTINCT user_id AS k FROM events)
    SELECT 'f' AS "left", 'p' AS "right", (SELECT count(*) FROM a JOIN b USING (k)) AS common UNION ALL SELECT 'f', 'e', (SELECT count(*) FROM a JOIN c USING (k))
    UNION ALL SELECT 'p', 'e', (SELECT count(*) FROM b JOIN c USING (k)) UNION ALL SELECT 'f', 'f', (SELECT count(*) FROM a) UNION ALL SELECT 'p', 'p', (SELECT count(*) FROM b) UNION ALL SELECT 'e', 'e', (SELECT count(*) FROM c)"""
)
def key_overlap_matrix(spark, sf):
    o = t(spark, sf, "orders").withColumn("k", F.col("o_custkey"))
    tables = {"f": o.where("o_orderstatus = 'F'"), "p": o.where("o_orderstatus = 'P'"), "e": t(spark, sf, "events").withColumn("k", F.col("user_id"))}
    return M.key_overlap(tables, ["k"])


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT user_id AS k FROM events)
    SELECT 'events' AS other, (SELECT count(*) FROM a JOIN b USING (k)) AS common, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_right"""
)
def overlap_report(spark, sf):
    a = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return M.overlap_report(a, {"events": t(spark, sf, "events").select(F.col("user_id").alias("k"))}, ["k"])


@query("(SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events)")
def key_intersection(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(t(spark, sf, "events").select(F.col("user_id").alias("k")))


@query("(SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events) UNION ALL (SELECT user_id AS k FROM events EXCEPT SELECT o_custkey FROM orders)")
def symmetric_difference(spark, sf):
    a = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = t(spark, sf, "events").select(F.col("user_id").alias("k"))
    return a.subtract(b).union(b.subtract(a))


@query("SELECT s.s_suppkey AS k, s_name AS name, NULL::VARCHAR AS segment FROM supplier s UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_missing_columns(spark, sf):
    a = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT 'retail' AS side, p_partkey, p_retailprice AS value FROM part UNION ALL SELECT 'size', p_partkey, p_size::DOUBLE FROM part")
def stack_columns(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("retail"), F.col("p_size").cast("double").alias("size"))
    return df.unpivot(["p_partkey"], ["retail", "size"], "side", "value")


@query(
    f"""WITH p AS (SELECT a.row_id AS id1, b.row_id AS id2, a.code AS c1, b.code AS c2, a.price AS p1, b.price AS p2, a.status AS s1, b.status AS s2 FROM ({O}) a JOIN ({O}) b ON a.subject = b.subject AND a.visit = b.visit AND a.row_id < b.row_id)
    SELECT id1, id2, concat_ws(',', CASE WHEN c1 IS DISTINCT FROM c2 THEN 'code' END, CASE WHEN p1 IS DISTINCT FROM p2 THEN 'price' END, CASE WHEN s1 IS DISTINCT FROM s2 THEN 'status' END) AS differs FROM p"""
)
def row_diff(spark, sf):
    v = order_visits(spark, sf)
    p = M.exact_join(v, v, ["subject", "visit"]).where("row_id_1 < row_id_2")
    return p.select(F.col("row_id_1").alias("id1"), F.col("row_id_2").alias("id2"), M.row_difference(p, ["code", "price", "status"]).alias("differs"))


@query(
    f"""WITH o AS (SELECT * FROM ({O})), s AS (SELECT * FROM ({S})), x AS (SELECT o.subject, o.visit, min(o.row_id) AS id1, min(s.row_id) AS id2 FROM o JOIN s ON o.subject = s.subject AND o.visit = s.visit
      GROUP BY ALL HAVING count(DISTINCT o.row_id) = 1 AND count(DISTINCT s.row_id) = 1)
    SELECT o.row_id AS row_id_1, s.row_id AS row_id_2, o.price AS price_1, s.quantity AS quantity_2 FROM o LEFT JOIN x ON x.id1 = o.row_id FULL JOIN s ON s.row_id = x.id2"""
)
def paired_visit_rows(spark, sf):
    v, s = order_visits(spark, sf), ship_visits(spark, sf)
    # an id may be on several rows of a visit: what counts is how many ids there are
    single = greedy(spark, sf).where("kind = 'exact' and size(array_distinct(ids1)) = 1 and size(array_distinct(ids2)) = 1")
    links = single.select(F.get("ids1", F.lit(0)).alias("id1"), F.get("ids2", F.lit(0)).alias("id2"))
    return M.paired_rows(v, s, links).select("row_id_1", "row_id_2", "price_1", "quantity_2")
