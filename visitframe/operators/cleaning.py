"""Row and cell filters of the cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions import scalars as X


def replace_unknown(df: DataFrame, extra: Sequence[object] = ()) -> DataFrame:
    """Unknown tokens of string and number columns become NULL."""
    number = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return df.select(
        *[
            X.unknown_to_null(F.col(f"`{c}`"), t, extra).alias(c) if t == "string" or t in number else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def category_projection(df: DataFrame, keys: Sequence[str], category: Sequence[str]) -> DataFrame:
    """Keys and the category's columns that are there, without rows where the latter are all
    NULL; no rows if there are none."""
    own = [c for c in category if c in df.columns]
    picked = df.select(*[c for c in keys if c in df.columns], *own)
    return drop_all_null(picked, own) if own else picked.limit(0)


def complete_only(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.lower(F.trim(F.col(column).cast("string"))).isin("complete", "1"))


def quality_filter(
    df: DataFrame, quality: str, measures: Sequence[str], spared: Sequence[str], part: str = "hippo",
    part_rules: Mapping[str, Sequence[str]] | None = None, strict_reference: bool = False,
) -> DataFrame:
    """Rows whose quality is fail or NULL go; where it names a part, all measures but the spared
    ones become NULL; where it is partial, the measures of every failed part rule do, unless
    strict_reference, which never looks at partial."""
    q = F.lower(F.trim(F.col(quality)))
    kept = df.where(q.isNotNull() & (q != "fail"))
    named = F.contains(q, F.lit(part))
    changes = {m: F.when(~named, F.col(f"`{m}`")) for m in measures if m not in set(spared)}
    out = kept.withColumns(changes)
    if strict_reference or not part_rules:
        return out
    failed = {}
    for flag, columns in part_rules.items():
        bad = (q == "partial") & ~F.coalesce(F.lower(F.col(flag)).isin("pass", "1"), F.lit(False))
        for c in columns:
            failed[c] = failed[c] | bad if c in failed else bad
    return out.withColumns({c: F.when(~F.coalesce(bad, F.lit(False)), F.col(f"`{c}`")) for c, bad in failed.items()})


def several_visits(df: DataFrame, subject: str, least: int = 2) -> DataFrame:
    """Rows of subjects with at least so many rows. A semi join against counts combined on the
    map side, so that no subject's rows meet in one task."""
    many = df.groupBy(subject).count().where(F.col("count") >= least).select(subject)
    return df.join(many, subject, "left_semi")


def enough_measures(df: DataFrame, date: str, measures: Sequence[str], least: int = 3) -> DataFrame:
    """Rows without a date need so many measures."""
    valid = sum((F.col(f"`{m}`").isNotNull().cast("int") for m in measures), F.lit(0))
    return df.where(F.col(date).isNotNull() | (valid >= least))


def within_range_of(df: DataFrame, real: DataFrame, column: str, tolerance_percent: float = 5) -> DataFrame:
    """Rows of df within the range of real's column, widened by a share of it. The range is one
    row, which is what travels."""
    bounds = real.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    slack = (F.col("__hi") - F.col("__lo")) * F.lit(tolerance_percent / 100)
    return (
        df.crossJoin(F.broadcast(bounds))
        .where(F.col(column).between(F.col("__lo") - slack, F.col("__hi") + slack))
        .drop("__lo", "__hi")
    )


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def members_of(df: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def deterministic_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows without replacement, the same in every run."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def balance_sizes(real: DataFrame, synthetic: DataFrame, keys: Sequence[str], tolerance_percent: float = 15) -> DataFrame:
    """real, cut to the synthetic size where that is smaller by more than the tolerance."""
    n_real, n_synthetic = real.count(), synthetic.count()
    if n_synthetic < n_real * (1 - tolerance_percent / 100):
        return deterministic_sample(real, n_synthetic, keys)
    return real


def up_to_subject(df: DataFrame, subject: str, value: object, order: str) -> DataFrame:
    """Rows up to the last row of one subject, in the order of a unique column."""
    last = df.where(F.col(subject) == value).agg(F.max(order).alias("__last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(order) <= F.col("__last")).drop("__last")


def combination_filter(df: DataFrame, combination: Mapping[str, object]) -> DataFrame:
    """Equality on every key that is a column and has a value."""
    for c, v in combination.items():
        if v is not None and c in df.columns:
            df = df.where(F.col(f"`{c}`") == F.lit(v))
    return df


def two_methods_long(
    df: DataFrame, keys: Sequence[str], methods: Mapping[str, Mapping[str, str]], column: str = "method"
) -> DataFrame:
    """One row per method that has any value: methods maps a label to {variable: its column}.
    One pass: an array of structs is exploded."""
    rows = [
        F.struct(F.lit(label).alias(column), *[F.col(f"`{src}`").alias(out) for out, src in columns.items()])
        for label, columns in methods.items()
    ]
    outs = list(next(iter(methods.values())))
    exploded = df.select(*keys, F.explode(F.array(*rows)).alias("__m")).select(*keys, "__m.*")
    return drop_all_null(exploded, outs)


def hierarchy_flag(rules: Sequence[tuple[Column, Column | None, str]]) -> Column:
    """The first rule that applies decides: (value, cutoff, comparison), comparison being >=, <
    or = for a value that is a flag itself. A rule applies if value and cutoff are there."""
    out = []
    for value, cutoff, op in rules:
        if op == "=":
            out.append(F.when(value.isin(0, 1), value.cast("int")))
            continue
        hit = value >= cutoff if op == ">=" else value < cutoff
        out.append(F.when(value.isNotNull() & cutoff.isNotNull(), hit.cast("int")))
    return F.coalesce(*out)


def cutoff_lookup(df: DataFrame, cutoffs: DataFrame, marker: str, method: str, out: str) -> DataFrame:
    """df with the cutoff of a marker for each row's method: cutoffs has marker, method, cutoff. An
    entry that is there but NULL doesn't fall back; a method without an entry takes `unknown`."""
    own = cutoffs.where(F.col("marker") == marker).select(F.lower("method").alias("__method"), F.col("cutoff").alias("__cut"))
    other = own.where("__method = 'unknown'").agg(F.first("__cut").alias("__other"))
    joined = df.withColumn("__key", F.lower(method)).join(own, F.col("__key") == F.col("__method"), "left")
    value = F.when(F.col("__method").isNotNull(), F.col("__cut")).otherwise(F.col("__other"))
    return joined.crossJoin(F.broadcast(other)).withColumn(out, value).drop("__key", "__method", "__cut", "__other")


def drop_single_visit_codes(df: DataFrame, subject: str, code: str, recoded: Sequence[str] = ("f", "sc")) -> DataFrame:
    """Screening codes become 0; subjects that have only such a visit go; a subject with both codes
    fails the job."""
    w = Window.partitionBy(subject)
    has = [F.max((F.col(code) == c).cast("int")).over(w) for c in recoded]
    marked = df.withColumns({"__n": F.count("*").over(w), "__a": has[0], "__b": has[1]})
    both = F.assert_true(~((F.col("__a") == 1) & (F.col("__b") == 1)), F.lit("a subject has both screening codes"))
    return (
        marked.where(both.isNull())
        .where((F.col("__n") > 1) | ~F.coalesce(F.col(code).isin(*recoded), F.lit(False)))
        .withColumn(code, F.when(F.col(code).isin(*recoded), F.lit("0")).otherwise(F.col(code)))
        .drop("__n", "__a", "__b")
    )
