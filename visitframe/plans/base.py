"""The registry decorator and the tables that queries share, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums differ in their last bits with the order of addition."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t == "double"})


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


# visits from orders: a NULL price every seventh, a NULL date every 97th, a NULL code every fifth
ORDER_VISITS_SQL = """
SELECT o_custkey AS subject, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate::DATE END AS visit, o_orderkey AS row_id,
       CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'bl' ELSE 'm' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') END END AS code,
       o_orderstatus AS status, o_orderpriority AS priority,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
       CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 31)::DOUBLE END AS score
FROM orders"""


def order_visits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, F.lit("bl")).otherwise(F.concat(F.lit("m"), F.lpad((k % 24).cast("string"), 2, "0")))
    return t(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject"),
        F.when(k % 97 != 0, F.col("o_orderdate").cast("date")).alias("visit"),
        k.alias("row_id"),
        F.when(k % 5 != 0, code).alias("code"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 4 != 0, (k % 31).cast("double")).alias("score"),
    )


SHIP_VISITS_SQL = """
SELECT o_custkey AS subject, l_shipdate::DATE AS visit, l_orderkey * 8 + l_linenumber AS row_id,
       CASE WHEN l_linenumber = 1 THEN 'bl' ELSE 'm' || lpad((l_orderkey % 24)::VARCHAR, 2, '0') END AS code,
       l_returnflag AS flag, CASE WHEN l_partkey % 6 <> 0 THEN l_quantity END AS quantity,
       CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice END AS amount, l_tax AS tax, l_discount AS discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def ship_visits(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("l_linenumber") == 1, F.lit("bl")).otherwise(
        F.concat(F.lit("m"), F.lpad((F.col("l_orderkey") % 24).cast("string"), 2, "0"))
    )
    # only what the visits hold goes through the join
    items = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("visit"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_partkey") % 6 != 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_extendedprice")).alias("amount"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"),
    )
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("subject"), "visit", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), code.alias("code"),
        "flag", "quantity", "amount", "tax", "discount",
    )


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Real and synthetic stand-ins: rows with an even and an odd key."""
    return df.where(F.col(key) % 2 == 0), df.where(F.col(key) % 2 == 1)
