"""Windows over a subject's visits: months, one row per visit, conflicts, imputation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions import scalars
from visitframe.functions.scalars import MONTH_DAYS


def nulls_in(columns: Sequence[str]) -> Column:
    return sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))


def visit_month(df: DataFrame, subject: str, date: str, out: str = "visit_month") -> DataFrame:
    """Half-even rounded months since the subject's first date."""
    first = F.min(date).over(Window.partitionBy(subject))
    return df.withColumn(out, F.bround(F.datediff(date, first) / F.lit(MONTH_DAYS)).cast("long"))


def one_row_per_visit(
    df: DataFrame, subject: str, date: str, code: str | None, essential: Sequence[str], order: Sequence[str],
    strategy: str = "strategy",
) -> DataFrame:
    """One row per (subject, date) and the rule that chose it: equal essential values - the first
    row; else the one with the fewest NULLs; on ties the first whose code is bl or starts with m;
    else the first."""
    by = [subject, date]
    group = Window.partitionBy(*by)
    values = [c for c in df.columns if c not in (*by, *order)]
    code_rank = F.lit(1) if code is None else F.when(
        F.lower(code).isin("bl") | F.coalesce(F.lower(code).startswith("m"), F.lit(False)), 0
    ).otherwise(1)
    marked = df.withColumns({"__nulls": nulls_in(values), "__code": F.coalesce(code_rank, F.lit(1)), "__n": F.count("*").over(group)})
    marked = marked.withColumns(
        {
            "__distinct": sum((F.size(F.collect_set(F.col(f"`{c}`")).over(group)) for c in essential), F.lit(0)),
            "__least": F.min("__nulls").over(group),
        }
    )
    tied = F.sum((F.col("__nulls") == F.col("__least")).cast("int")).over(group)
    coded = F.max(F.when(F.col("__nulls") == F.col("__least"), 1 - F.col("__code"))).over(group)
    equal = (F.col("__distinct") == len(essential)) if essential else F.lit(False)
    marked = marked.withColumns({"__tied": tied, "__coded": coded, "__equal": equal})
    pick = [
        F.when(F.col("__equal"), 0).otherwise(F.col("__nulls")),
        F.when(F.col("__equal"), 0).otherwise(F.col("__code")),
        *order,
    ]
    label = (
        F.when(F.col("__n") == 1, F.lit(None).cast("string"))
        .when(F.col("__equal"), "Equal values")
        .when(F.col("__tied") == 1, "Min null values")
        .when(F.lit(code is None), "First row")
        .when(F.col("__coded") == 1, "VISITCODE priority")
        .otherwise("first row, same VISITCODE")
    )
    w = group.orderBy(*pick)
    out = marked.withColumn(strategy, label).withColumn("__no", F.row_number().over(w)).where("__no = 1")
    return out.drop("__no", "__nulls", "__code", "__n", "__distinct", "__least", "__tied", "__coded", "__equal")


def best_rank(measures: Sequence[str], status: str | None = None, strength: str | None = None) -> list[Column]:
    """What ranks the rows of a visit: fewest NULL measures, then status complete before partial before others, then the higher strength."""
    rank = [nulls_in(measures)]
    if status:
        s = F.lower(F.trim(F.col(status).cast("string")))
        rank.append(F.when(s == "complete", 0).when(s == "partial", 1).otherwise(2))
    if strength:
        rank.append(F.coalesce(-F.col(strength).cast("double"), F.lit(float("inf"))))
    return rank


def best_row(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], order: Sequence[str], status: str | None = None,
    strength: str | None = None,
) -> DataFrame:
    """Of each key's rows the best by best_rank, then the first. An arg-min that combines on the map
    side: struct order is the ranking. Every column moves once, those of the order as part of the ranking."""
    rank = [c.alias(f"r{k}") for k, c in enumerate(best_rank(measures, status, strength))]
    ordered = [c for c in dict.fromkeys(order) if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in ordered]
    packed = df.select(*keys, F.struct(*rank, *[F.col(c).alias(f"o_{c}") for c in ordered], F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("row")).alias("__r"))
    picked = packed.groupBy(*keys).agg(F.min("__r").alias("__r"))
    found = {c: F.col(f"__r.`o_{c}`") for c in ordered} | {c: F.col(f"__r.row.`{c}`") for c in rest}
    return picked.select(*[found[c].alias(c) if c in found else F.col(f"`{c}`") for c in df.columns])


def dedup_visits(
    df: DataFrame, subject: str, date: str, code: str, measures: Sequence[str], order: Sequence[str],
    status: str | None = None, strength: str | None = None, least: int = 3,
) -> DataFrame:
    """Dated rows: best of (subject, date). Undated rows: with at least so many measures, best of
    (subject, code)."""
    dated = best_row(df.where(F.col(date).isNotNull()), [subject, date], measures, order, status, strength)
    valid = len(measures) - nulls_in(measures)
    undated = df.where(F.col(date).isNull() & (valid >= least))
    return dated.unionByName(best_row(undated, [subject, code], measures, order, status, strength).select(df.columns))


def consolidate(
    df: DataFrame, keys: Sequence[str], fill: Sequence[str], order: Sequence[str],
    ranked: Mapping[str, Sequence[str]] | None = None, valid: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Within a group: NULLs take the group's first value; ranked columns the highest of a hierarchy
    (other values only if none is in it); valid columns replace invalid values by the first valid
    one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    changes = {c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(w)) for c in fill}
    for c, hierarchy in (ranked or {}).items():
        place = F.array_position(F.array(*[F.lit(x) for x in hierarchy]), F.col(c))
        top = F.max(F.when(place > 0, place)).over(w)
        named = F.element_at(F.array(*[F.lit(x) for x in hierarchy]), top.cast("int"))
        changes[c] = F.when(top.isNotNull(), named).otherwise(F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(w)))
    for c, ok in (valid or {}).items():
        first_ok = F.first(F.when(ok, F.col(c)), ignorenulls=True).over(w)
        changes[c] = F.when(ok, F.col(c)).otherwise(F.coalesce(first_ok, F.col(c)))
    return df.withColumns(changes)


def newest_then_trend(
    df: DataFrame, subject: str, date: str, stamp: str, score: str, order: Sequence[str], rising: bool = True
) -> DataFrame:
    """One row per (subject, date): the newest stamp; among equals the one that follows the trend
    from the subject's previous date; else the first."""
    per_visit = df.groupBy(subject, date).agg(F.max(score).alias("__m"))
    previous = per_visit.withColumn("__prev", F.lag("__m").over(Window.partitionBy(subject).orderBy(date))).drop("__m")
    joined = df.join(previous, [subject, date])
    follows = (F.col(score) >= F.col("__prev")) if rising else (F.col(score) <= F.col("__prev"))
    w = Window.partitionBy(subject, date).orderBy(
        F.col(stamp).desc_nulls_last(), F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1), *order
    )
    return joined.withColumn("__no", F.row_number().over(w)).where("__no = 1").drop("__no", "__prev")


def _visit_stream(df: DataFrame, subject: str, order: Sequence[str], step: Callable, schema: str) -> DataFrame:
    """step(batch, state) -> (batch, state) over each subject's rows in order: rows are dealt by subject, sorted in
    Spark and streamed, so no subject is held whole. state is None at a subject's first row. They are dealt by a hash, since behind a
    join on the subject Spark would leave the exchange out and may read that join's shuffle where it lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            keys = batch[subject].astype(object).where(batch[subject].notna(), None)
            codes = (keys != keys.shift()).cumsum() if len(keys) else keys
            for _, part in batch.groupby(codes.to_numpy(), sort=False):
                own = (keys.loc[part.index[0]],)
                if own != last:
                    last, state = own, None
                done, state = step(part, state)
                yield done

    return df.repartition(F.xxhash64(subject)).sortWithinPartitions(subject, *order).mapInPandas(run, schema)


def merge_two_sources(
    df: DataFrame, subject: str, date: str, a: str, b: str, out: str, low: float, high: float, rising: bool = True
) -> DataFrame:
    """One numeric column from two: the value in range; if both are, the one that continues the
    trend of what was chosen before, closer to it on ties. What is chosen depends on what was
    chosen before, so a subject's visits are streamed in order with the last choice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, previous = None, None
        for batch in batches:
            chosen = []
            keys = batch[subject].astype(object).where(batch[subject].notna(), None)
            for own, x, y in zip(keys.tolist(), batch[a].to_numpy(float).tolist(), batch[b].to_numpy(float).tolist(), strict=True):
                if own != last:
                    last, previous = own, None
                x_fits, y_fits = low <= x <= high, low <= y <= high
                if x_fits and y_fits and previous is not None:
                    x_on, y_on = (x >= previous, y >= previous) if rising else (x <= previous, y <= previous)
                    value = x if x_on > y_on or (x_on == y_on and abs(x - previous) <= abs(y - previous)) else y
                else:
                    value = x if x_fits else y if y_fits else None
                chosen.append(value)
                previous = previous if value is None else value
            yield batch.assign(**{out: np.array(chosen, float)})

    rest = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out) + f", `{out}` double"
    order = [date, *[c for c in rest if c not in (subject, date)]]
    # dealt by a hash, for the reason that _visit_stream gives
    done = df.drop(out).repartition(F.xxhash64(subject)).sortWithinPartitions(subject, *order).mapInPandas(run, schema)
    return done.withColumn(out, F.nanvl(out, F.lit(None)))


def impute_visit_code(df: DataFrame, subject: str, date: str, code: str, needed: Sequence[str]) -> DataFrame:
    """A missing code follows from the last coded visit before (its months plus the time since) or
    is bl; rows without any of the needed values go."""
    w = Window.partitionBy(subject).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.lower(F.col(code))
    months = F.when(lower == "bl", 0).otherwise(F.substring(lower, 2, 9).try_cast("int"))
    last = F.last(F.when(F.col(code).isNotNull(), F.struct(months.alias("m"), F.col(date).alias("d"))), ignorenulls=True).over(w)
    later = last["m"] + F.bround(F.datediff(F.col(date), last["d"]) / F.lit(MONTH_DAYS)).cast("int")
    made = F.when(last.isNull(), F.lit("bl")).otherwise(F.concat(F.lit("m"), F.lpad(later.cast("string"), 2, "0")))
    filled = df.withColumn(code, F.coalesce(F.col(code), made))
    return filled.dropna(how="all", subset=list(needed)) if needed else filled


def age_from_baseline(df: DataFrame, subject: str, date: str, months: str, age: str, order: Sequence[str] = ()) -> DataFrame:
    """Missing ages from the subject's baseline row (months = 0): its age plus the time since its date, or without a
    date plus the visit's months. Subjects without a baseline age keep what they have."""
    w = Window.partitionBy(subject).orderBy(*(order or [date])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.when(F.col(months) == 0, F.struct(F.col(age).alias("age"), F.col(date).alias("date"))), ignorenulls=True).over(w)
    marked = df.withColumn("__base", base)
    dated = scalars.age(exam=F.col(date), age_baseline=F.col("__base.age"), baseline=F.col("__base.date"))
    undated = scalars.age(age_baseline=F.col("__base.age"), months=F.col(months))
    made = F.when(F.col("__base.date").isNotNull(), dated).otherwise(undated)
    return marked.withColumn(age, F.coalesce(F.col(age), made)).drop("__base")


def baseline_snapshot(df: DataFrame, subject: str, time: str, features: Sequence[str]) -> DataFrame:
    """Per subject the first value of every feature that isn't NULL, in time order; an aggregate that
    combines on the map side."""
    return df.groupBy(subject).agg(
        *[F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(time))).alias(c) for c in features]
    )


def last_visits(df: DataFrame, subject: str, time: str, n: int = 1, rest: bool = False) -> DataFrame:
    """The last n visits of each subject, or all the others."""
    w = Window.partitionBy(subject).orderBy(F.col(time).desc())
    no = df.withColumn("__no", F.row_number().over(w))
    return no.where(F.col("__no") > n if rest else F.col("__no") <= n).drop("__no")


def first_visit(df: DataFrame, subject: str, time: str, rest: bool = False) -> DataFrame:
    w = Window.partitionBy(subject).orderBy(time)
    no = df.withColumn("__no", F.row_number().over(w))
    return no.where("__no > 1" if rest else "__no = 1").drop("__no")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return best_row(df, keys, [], order)


def months_from_baseline(df: DataFrame, subject: str, years: str, out: str = "month") -> DataFrame:
    return df.withColumn(out, (F.col(years) - F.min(years).over(Window.partitionBy(subject))) * 12)


def largest_step(df: DataFrame, subject: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Per subject the largest absolute change between consecutive visits, per column."""
    w = Window.partitionBy(subject).orderBy(time)
    steps = df.select(subject, *[F.abs(F.lead(c).over(w) - F.col(c)).alias(c) for c in columns])
    return steps.groupBy(subject).agg(*[F.max(c).alias(c) for c in columns])


def renumber(df: DataFrame, subject: str, out: str, pattern: str = "S%05d") -> DataFrame:
    """Subjects numbered from 0 in their order. The distinct ids are range-partitioned and each
    partition's offset added, so no task sees all of them."""
    from visitframe.operators.ordering import global_index

    ids = global_index(df.select(subject).distinct(), [subject], "__n")
    return df.join(ids.select(subject, F.format_string(pattern, F.col("__n")).alias(out)), subject)


def first_crossings(df: DataFrame, subject: str, time: str, thresholds: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Per subject the markers in the order in which they first cross their thresholds (>= or <),
    joined by ' > '."""
    firsts = {}
    for c, (op, limit) in thresholds.items():
        hit = F.col(c) >= limit if op == ">=" else F.col(c) < limit
        firsts[c] = F.min(F.when(hit, F.col(time)))
    per = df.groupBy(subject).agg(*[e.alias(c) for c, e in firsts.items()])
    events = F.array(*[F.struct(F.col(c).alias("t"), F.lit(c).alias("m")) for c in thresholds])
    ordered = F.array_sort(F.filter(events, lambda e: e["t"].isNotNull()))
    return per.select(subject, F.array_join(F.transform(ordered, lambda e: e["m"]), " > ").alias("sequence"))


def top_sequences(sequences: DataFrame, most: int = 10) -> DataFrame:
    """(rank, sequence, n, share): the `most` most frequent sequences, of equal counts the smaller text first. Subjects whose markers never cross
    (empty sequences) count in the shares but have no rank. Counts combine before they move, and only `most` rows are sorted out."""
    counts = sequences.groupBy("sequence").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    top = counts.where((F.col("sequence") != "") & F.col("sequence").isNotNull()).orderBy(F.desc("n"), "sequence").limit(most)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "sequence")))  # `most` rows
    return ranked.crossJoin(F.broadcast(total)).select("rank", "sequence", "n", (F.col("n") / F.col("__total")).alias("share"))


def top_overlap(one: DataFrame, other: DataFrame, most: int = 5) -> DataFrame:
    """One row: how many of the `most` first sequences of two tables of top_sequences are in both, and their share of `most`."""
    a, b = (t.where(F.col("rank") <= most).select("sequence") for t in (one, other))
    return a.join(b, "sequence").agg(F.count("*").alias("n_common"), (F.count("*") / F.lit(most)).alias("share"))


def compare_sequences(real: DataFrame, synthetic: DataFrame, most: int = 10, first: int = 5) -> DataFrame:
    """One row: the share of the `first` sequences that two tables (subject, sequence) have in common, Kendall's tau of the counts
    of the sequences that are among the `most` of both (0 with p-value 1 if there is one at most), and whether the order of events is kept."""
    from visitframe.operators.stats import kendall_tau

    tops = [top_sequences(t, most) for t in (real, synthetic)]
    both = tops[0].select("sequence", F.col("n").alias("a")).join(tops[1].select("sequence", F.col("n").alias("b")), "sequence")
    found = kendall_tau(both, "a", "b")
    tau, p = (found["tau"], found["p"]) if found["n"] > 1 else (0.0, 1.0)
    shared = top_overlap(*tops, first).select(F.col("share").alias("overlap"))
    out = shared.select("overlap", F.lit(found["n"]).cast("long").alias("n_common"), F.lit(float(tau)).alias("tau"), F.lit(float(p)).alias("p_value"))
    return out.withColumn("passed", (F.col("overlap") >= 0.6) & ~F.isnan("tau") & (F.col("tau") > 0.5))


def strictly_increasing(df: DataFrame, subject: str, time: str) -> DataFrame:
    """Equal times of a subject move up by the smallest possible step; visits are streamed in order with the last time."""

    def spread(g: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, float | None]:
        t = g[time].to_numpy(float).copy()
        for i in range(len(t)):
            if last is not None and t[i] <= last:
                t[i] = np.nextafter(last, np.inf)
            last = last if np.isnan(t[i]) else t[i]
        return g.assign(**{time: t}), last

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return _visit_stream(df, subject, [time, *[c for c in df.columns if c not in (subject, time)]], spread, schema)


def densify(df: DataFrame, subject: str, month: str, step: int, static: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Every step from a subject's first to last month: static columns carried, measures where there
    are visits, and a 0/1 mask for each."""
    ends = df.groupBy(subject).agg(
        F.min(month).alias("__a"), F.max(month).alias("__b"), *[F.min_by(c, month).alias(c) for c in static]
    )
    grid = ends.withColumn(month, F.explode(F.sequence("__a", "__b", F.lit(step)))).drop("__a", "__b")
    seen = df.groupBy(subject, month).agg(*[F.max(c).alias(c) for c in measures])
    out = grid.join(seen, [subject, month], "left")
    return out.withColumns({f"{c}_mask": F.col(c).isNotNull().cast("int") for c in measures})


def curve_interval(df: DataFrame, time: str, value: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(value).between(low, high)).agg(F.min(time).alias("start"), F.max(time).alias("end"))


