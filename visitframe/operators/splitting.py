"""Subject-level splits that a hash decides: the same in every run and partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_subjects(df: DataFrame, subject: str, share: float, seed: int = 42, least_one: bool = False) -> DataFrame:
    """(subject, n_visits, part): of every stratum of visit counts floor(share * n) subjects are
    `train` (at least one if asked for). Subjects of a stratum are taken in hash order, and their
    places come from counts per hash range, so a stratum that holds most subjects is no
    bottleneck."""
    buckets = 64
    per = df.groupBy(subject).agg(F.count("*").alias("n_visits"))
    per = per.withColumn("__h", F.xxhash64(subject, F.lit(seed))).withColumn("__b", F.shiftrightunsigned("__h", 58))
    sizes = per.groupBy("n_visits", "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("n_visits").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("n_visits").alias("__v"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy("n_visits")).alias("__all"),
    )
    inside = Window.partitionBy("n_visits", "__b").orderBy(F.shiftrightunsigned("__h", 1), "__h", subject)
    placed = per.join(offsets, (F.col("n_visits") == F.col("__v")) & (F.col("__b") == F.col("__c")))
    place = F.col("__before") + F.row_number().over(inside)
    take = F.floor(F.col("__all") * F.lit(share))
    take = F.greatest(take, F.lit(1)) if least_one else take
    return placed.select(subject, "n_visits", F.when(place <= take, "train").otherwise("validation").alias("part"))


def fold_of(df: DataFrame, subject: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(subject, F.lit(seed)), F.lit(k)).cast("int"))


def allocate(n: int, shares: Mapping[str, float]) -> dict[str, int]:
    """n subjects over classes; the last class takes the remainder."""
    names = list(shares)
    out = {c: int(n * shares[c]) for c in names[:-1]}
    return out | {names[-1]: n - sum(out.values())}


def relax_conditions(df: DataFrame, subject: str, conditions: Sequence[tuple[str, object]], least: int = 10) -> tuple[list[tuple[str, object]], int]:
    """The longest run of leading conditions that at least so many subjects meet, and how many do:
    one aggregate over all runs."""
    runs = [conditions[:k] for k in range(len(conditions), -1, -1)]
    met = []
    for run in runs:
        ok = F.lit(True)
        for c, v in run:
            ok = ok & (F.col(c) == F.lit(v))
        met.append(F.countDistinct(F.when(ok, F.col(subject))).alias(f"n{len(run)}"))
    row = df.agg(*met).first()
    for run in runs:
        if row[f"n{len(run)}"] >= least:
            return list(run), row[f"n{len(run)}"]
    return [], row["n0"]
