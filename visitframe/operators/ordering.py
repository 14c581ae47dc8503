"""Positions and running sums in a global order without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitframe.session import materialize


def _ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df dealt in ranges of `order` to as many tasks as the session shuffles to (which is set by the size of the
    data), plus the range's number `__part`. Bounds are sampled, so all that follows reads one evaluation."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))


def global_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """df with each row's position (from 0) in the order of columns that tell rows apart: rows are numbered
    inside sorted ranges and shifted by the sizes of the ranges before."""
    part = _ranges(df, order)
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        part.join(F.broadcast(offsets), "__part")  # one row per range
        .withColumn(out, F.col("__before") + F.col("__at") - F.col("__first"))
        .drop("__part", "__first", "__before", "__at")
    )


def place_in_group(df: DataFrame, group: str, order: Sequence[str], out: str) -> DataFrame:
    """df with each row's place (from 0) among the rows of its group. Rows are numbered in sorted ranges; a group that
    starts in an earlier range goes on from there."""
    part = _ranges(df, [group, *order])
    inside = Window.partitionBy("__part", group).orderBy("__at")
    sizes = part.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first group of a range can have begun before it: no more rows than ranges
    offsets = sizes.withColumn("__before", F.sum("__n").over(before)).where("__before > 0").select(group, "__part", "__before")
    placed = part.withColumn(out, F.row_number().over(inside).cast("long") - 1).join(F.broadcast(offsets), [group, "__part"], "left")
    return placed.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop("__part", "__at", "__before")


def running_sums(df: DataFrame, order: str | Sequence[str], sums: dict[str, str]) -> DataFrame:
    """df (one row per value of `order`, a column or several) plus running sums out -> column up to and with each row: sums of
    the ranges before are added to sums inside a range."""
    part = _ranges(df, [order] if isinstance(order, str) else order)
    per = part.groupBy("__part").agg(*[F.sum(c).alias(f"__s_{o}") for o, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("__part", *[F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in sums])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = part.join(F.broadcast(offsets), "__part")  # one row per range
    return out.withColumns({o: F.col(f"__b_{o}") + F.sum(c).over(inside) for o, c in sums.items()}).drop(
        "__part", "__at", *[f"__b_{o}" for o in sums]
    )


def splice(df: DataFrame, rows: DataFrame, order: Sequence[str], rows_order: Sequence[str], at: int, out: str) -> DataFrame:
    """df with other rows put in before the position `at` of its order: `out` is each row's place."""
    n = rows.count()
    own = global_index(df, order, out).withColumn(out, F.col(out) + F.when(F.col(out) >= at, n).otherwise(0))
    put = global_index(rows, rows_order, out).withColumn(out, F.col(out) + at)
    return own.unionByName(put, allowMissingColumns=True)


def order_columns(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """Columns of reports in their order: the first ones, all others as they stand, the last ones. Names that aren't
    there are passed over."""
    head = [c for c in first if c in df.columns]
    tail = [c for c in last if c in df.columns and c not in head]
    middle = [c for c in df.columns if c not in head and c not in tail]
    return df.select(*[F.col(f"`{c}`") for c in [*head, *middle, *tail]])
