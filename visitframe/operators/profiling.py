"""Column profiles, merge statistics and pre-checks of a synthetic table against a real one."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.operators.ordering import running_sums

CHECK = "check string, variable string, metric string, real double, synthetic double, verdict string"


def visits_per_subject(df: DataFrame, subject: str) -> DataFrame:
    return df.groupBy(subject).agg(F.count("*").alias("n_visits"))


def merge_statistics(df: DataFrame, subject: str, date: str) -> DataFrame:
    """One row: sizes, visits per subject, date range, NULL shares."""
    per = visits_per_subject(df, subject).agg(
        F.count("*").alias("n_subjects"),
        F.min("n_visits").alias("visits_min"),
        F.max("n_visits").alias("visits_max"),
        F.avg("n_visits").alias("visits_mean"),
        F.percentile("n_visits", 0.5).alias("visits_median"),
        F.stddev("n_visits").alias("visits_std"),
        F.percentile("n_visits", 0.25).alias("visits_q25"),
        F.percentile("n_visits", 0.75).alias("visits_q75"),
    )
    share = [F.count_if(F.col(f"`{c}`").isNull()) * 100.0 / F.count("*") for c in df.columns]
    whole = df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.min(date).cast("date").alias("date_min"),
        F.max(date).cast("date").alias("date_max"),
        F.array(*share).alias("__null"),
    )
    nulls = F.aggregate("__null", F.lit(0.0), lambda a, x: a + x) / len(df.columns)
    whole = whole.select(
        "n_rows", "n_columns", "date_min", "date_max", nulls.alias("null_mean"), F.array_max("__null").alias("null_max"),
        F.size(F.filter("__null", lambda x: x == 0)).cast("long").alias("complete_columns"),
        F.size(F.filter("__null", lambda x: x > 0)).cast("long").alias("columns_with_null"),
    )
    return whole.crossJoin(F.broadcast(per))  # one row each


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(variable, nulls, null_percent), one aggregate for all columns."""
    columns = list(columns or df.columns)
    agg = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    long = agg.unpivot(["__n"], [f"`{c}`" for c in columns], "variable", "nulls")
    return long.select("variable", "nulls", (F.col("nulls") * 100.0 / F.col("__n")).alias("null_percent"))


def column_profile(df: DataFrame, columns: Sequence[str], keep_share: float = 0.65, classes: int = 10) -> DataFrame:
    """(variable, total, valid, missing, low, high, classes, decision) per column; classes are
    listed up to a limit, the decision drops columns with too few values."""
    stats = []
    for c in columns:
        own = F.col(f"`{c}`")
        stats.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.count("*").alias("total"),
                F.count(own).alias("valid"),
                F.count_if(own.isNull()).alias("missing"),
                F.min(own).cast("string").alias("low"),
                F.max(own).cast("string").alias("high"),
                F.approx_count_distinct(own).alias("distinct"),
            )
        )
    rows = df.agg(F.array(*stats).alias("__s")).select(F.explode("__s").alias("s")).select("s.*")
    keep = F.col("valid") / F.col("total") > keep_share
    few = F.when(F.col("distinct") <= classes, F.lit("class")).otherwise("range")
    return rows.select(
        "variable", "total", "valid", "missing", "low", "high", few.alias("kind"), F.when(keep, "keep").otherwise("drop").alias("decision")
    )


def subjects_with_values(df: DataFrame, subject: str, columns: Sequence[str]) -> DataFrame:
    """(variable, subjects, subjects_multiple): with a value, with at least two."""
    per = df.groupBy(subject).agg(*[F.count(f"`{c}`").alias(c) for c in columns])
    agg = per.agg(
        *[F.struct(F.count_if(F.col(f"`{c}`") > 0).alias("s"), F.count_if(F.col(f"`{c}`") > 1).alias("m")).alias(c) for c in columns]
    )
    return agg.unpivot([], [f"`{c}`" for c in columns], "variable", "v").select(
        "variable", F.col("v.s").alias("subjects"), F.col("v.m").alias("subjects_multiple")
    )


def present_populations(missing: DataFrame, file_code: str, lists: str, everything: Sequence[str]) -> DataFrame:
    """Per file the populations that not every variable misses."""
    agg = missing.groupBy(file_code).agg(F.collect_set(lists).alias("__all"))
    common = F.aggregate(F.slice("__all", 2, 100_000), F.get("__all", F.lit(0)), F.array_intersect)
    present = F.array_except(F.array(*[F.lit(p) for p in everything]), common)
    return agg.select(file_code, F.array_join(F.array_sort(present), ",").alias("present"))


def population_column(df: DataFrame, subject: str, columns: Sequence[str], cohorts: Sequence[str]) -> DataFrame:
    """(variable, varying) of the columns whose values contain a cohort's name, the one with the
    fewest subjects with several values first."""
    hit = lambda c: reduce(lambda a, b: a | b, [F.contains(F.upper(F.col(c).cast("string")), F.lit(x)) for x in cohorts])
    per = df.groupBy(subject).agg(*[F.struct(F.max(hit(c)).alias("h"), F.min(c).eqNullSafe(F.max(c)).alias("same")).alias(c) for c in columns])
    agg = per.agg(*[F.struct(F.max(F.col(f"{c}.h")).alias("h"), F.count_if(~F.col(f"{c}.same")).alias("v")).alias(c) for c in columns])
    long = agg.unpivot([], list(columns), "variable", "s")
    return long.where("s.h").select("variable", F.col("s.v").alias("varying")).orderBy("varying", "variable")


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.01, 0.99)) -> DataFrame:
    """(variable, p..) with linear interpolation. Values are counted and numbered by running counts over ranges; a percentile
    lies between the two values at the places around it, so no task reads all distinct values."""
    return reduce(DataFrame.unionByName, [_percentiles_of(df, c, shares) for c in columns])


def _percentiles_of(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    v = df.select(F.col(f"`{column}`").cast("double").alias("v")).where("v is not null")
    placed = running_sums(v.groupBy("v").agg(F.count("*").alias("n")), "v", {"upto": "n"})
    at = [F.col("last") * F.lit(float(s)) for s in shares]
    both = placed.crossJoin(F.broadcast(placed.agg((F.max("upto") - 1).alias("last"))))  # one row
    ends = [F.min(F.when(F.col("upto") > place(p), F.col("v"))).alias(f"{n}{k}") for k, p in enumerate(at) for n, place in (("low", F.floor), ("high", F.ceil))]
    row = both.agg(F.max("last").alias("last"), *ends)

    def between(k: int) -> Column:
        low, high, p = F.col(f"low{k}"), F.col(f"high{k}"), at[k]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return row.select(F.lit(column).alias("variable"), *[between(k).alias(f"p{round(s * 100):02d}") for k, s in enumerate(shares)])


def describe(df: DataFrame, by: Sequence[str], column: str, digits: int = 2) -> DataFrame:
    c = F.col(column)
    stats = {"mean": F.avg(c), "std": F.stddev(c), "min": F.min(c), "max": F.max(c), "median": F.percentile(c, 0.5)}
    return df.groupBy(*by).agg(F.count(c).alias("count"), *[F.bround(e, digits).alias(n) for n, e in stats.items()])


def pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[object], agg: Column) -> DataFrame:
    """Listed pivot values: no extra job to find them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(agg)


def mean_where_no_median(df: DataFrame, keys: Sequence[str], batch: str, columns: Sequence[str], median: str = "MEDIAN") -> DataFrame:
    """Median rows as they are; visits without one get a row of means."""
    is_median = df.where(F.col(batch) == median).select(*keys, batch, *columns)
    without = df.join(is_median.select(*keys).distinct(), list(keys), "left_anti")
    means = without.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns]).withColumn(batch, F.lit(f"{median}_calculated"))
    return is_median.unionByName(means)


def class_shares(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(class, real_share, synthetic_share, difference) over the classes of both."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        c = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("__n"))
        return c.crossJoin(F.broadcast(df.agg(F.count("*").alias("__t")))).select("class", (F.col("__n") / F.col("__t")).alias(name))

    both = shares(real, "real_share").join(shares(synthetic, "synthetic_share"), "class", "full_outer")
    return both.select(
        "class", "real_share", "synthetic_share",
        F.abs(F.coalesce("real_share", F.lit(0.0)) - F.coalesce("synthetic_share", F.lit(0.0))).alias("difference"),
    )


def range_check(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], tolerance: float = 0.2) -> DataFrame:
    """(variable, real_min, real_max, synthetic_min, synthetic_max, inside) with a tolerance in
    shares of the real range."""

    def ends(df: DataFrame, name: str) -> DataFrame:
        agg = df.agg(*[F.struct(F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("b")).alias(c) for c in columns])
        return agg.unpivot([], list(columns), "variable", "v").select("variable", F.col("v.a").alias(f"{name}_min"), F.col("v.b").alias(f"{name}_max"))

    slack = (F.col("real_max") - F.col("real_min")) * tolerance
    inside = (F.col("synthetic_min") >= F.col("real_min") - slack) & (F.col("synthetic_max") <= F.col("real_max") + slack)
    return ends(real, "real").join(ends(synthetic, "synthetic"), "variable").withColumn("inside", inside)


def null_rate_difference(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], limit: float = 15) -> DataFrame:
    a = null_profile(real, columns).select("variable", F.col("null_percent").alias("real_percent"))
    b = null_profile(synthetic, columns).select("variable", F.col("null_percent").alias("synthetic_percent"))
    d = F.abs(F.col("real_percent") - F.col("synthetic_percent"))
    return a.join(b, "variable").withColumn("difference", d).withColumn("too_large", d > limit)


def longitudinal_check(real: DataFrame, synthetic: DataFrame, subject: str) -> DataFrame:
    """One row: subjects, visits per subject, their relative differences and verdicts (30 %, 40 %)."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return visits_per_subject(df, subject).agg(F.count("*").alias(f"{name}_subjects"), F.avg("n_visits").alias(f"{name}_visits"))

    both = one(real, "real").crossJoin(F.broadcast(one(synthetic, "synthetic")))  # one row each
    ds = F.abs(F.col("real_subjects") - F.col("synthetic_subjects")) / F.col("real_subjects")
    dv = F.abs(F.col("real_visits") - F.col("synthetic_visits")) / F.col("real_visits")
    return both.withColumns({"subjects_difference": ds, "visits_difference": dv, "subjects_ok": ds <= 0.3, "visits_ok": dv <= 0.4})


def size_verdict(ratio: Column) -> Column:
    return F.when(ratio < 0.3, "issue").when((ratio < 0.5) | (ratio > 2), "warning").otherwise("pass")


def schema_check(real: DataFrame, synthetic: DataFrame) -> list[tuple[str, str]]:
    """(column, problem) by name and by kind of type; metadata only."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    a, b = dict(real.dtypes), dict(synthetic.dtypes)
    out = [(c, "missing") for c in a if c not in b] + [(c, "extra") for c in b if c not in a]
    out += [(c, "type") for c in a if c in b and a[c] != b[c] and not {a[c], b[c]} <= numeric]
    return sorted(out)


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the values that are there."""
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, n)


def correlations(df: DataFrame, columns: Sequence[str], at_once: int = 200) -> DataFrame:
    """(a, b, r) of every two columns, pairwise complete. Up to at_once pairs are one aggregate; a plan for more would grow
    with the square of the columns, so then each task adds up the products of its rows as matrices."""
    couples = list(combinations(columns, 2))
    if len(couples) > at_once:
        return _correlations_by_products(df, columns)
    agg = df.agg(*[F.corr(f"`{a}`", f"`{b}`").alias(f"{a}|{b}") for a, b in couples])
    part = F.split("pair", r"\|")
    return agg.unpivot([], [f"`{c}`" for c in agg.columns], "pair", "r").select(F.get(part, F.lit(0)).alias("a"), F.get(part, F.lit(1)).alias("b"), "r")


def _correlations_by_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(str(k)) for k, c in enumerate(columns)])
    row = values.agg(*[F.avg(F.nanvl(str(k), F.lit(None))).alias(str(k)) for k in range(len(columns))]).first()
    center = np.array([v if v is not None else 0.0 for v in row])
    upper = np.triu_indices(len(columns), 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float) - center
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        cells = [pa.array(s[upper]) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)) for u in upper] + cells, names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    schema = "i int, j int, n double, x double, y double, xx double, yy double, xy double"
    s = values.mapInArrow(products, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = F.sqrt((F.col("xx") - x * x / n) * (F.col("yy") - y * y / n))
    r = F.when(n > 1, F.try_divide(F.col("xy") - x * y / n, spread))
    names = F.array(*[F.lit(c) for c in columns])
    return s.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r"))


def mae_with_interval(df: DataFrame, real: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error, its 95 % half-width and the number of complete pairs."""
    e = F.abs(F.col(real) - F.col(predicted))
    return df.groupBy(*by).agg(
        F.avg(e).alias("mae"), (1.96 * F.stddev_pop(e) / F.sqrt(F.count(e))).alias("half_width"), F.count(e).alias("n")
    )


def varying_within_subject(df: DataFrame, subject: str, column: str) -> DataFrame:
    return df.groupBy(subject).agg(F.countDistinct(column).alias("n_values")).where("n_values > 1")


def top(df: DataFrame, column: str, n: int = 5, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    order = F.col(column).desc() if largest else F.col(column).asc()
    return df.orderBy(order, *ties).limit(n)


def extremes(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.agg(
        F.min_by(key, F.struct(column, key)).alias("lowest"), F.max_by(key, F.struct(F.col(column), -F.col(key))).alias("highest")
    )


def distinct_values(df: DataFrame, columns: Sequence[str], allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(filter, value): the distinct values of filter columns as text, whitelisted."""
    out = []
    for c in columns:
        own = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("filter"), F.col(c).cast("string").alias("value")).distinct()
        if allowed and c in allowed:
            own = own.where(F.col("value").isin(list(allowed[c])))
        out.append(own)
    return reduce(DataFrame.unionByName, out)


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, share): the empirical distribution function at its steps. Counts per value come
    first, so the running sum goes over distinct values in range buckets."""
    from visitframe.operators.stats import running_share

    return running_share(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value")))


def ordered_by_nulls(df: DataFrame) -> DataFrame:
    return null_profile(df).orderBy(F.col("nulls").desc(), "variable")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__no", F.row_number().over(w)).where("__no = 1").drop("__no")
