"""Encoding, scaling and their inverses; dictionary-driven projection and renaming."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from visitframe.functions import scalars as X


def dummies(df: DataFrame, column: str, values: Sequence[object], labels: Mapping[object, str] | None = None, sep: str = "/") -> DataFrame:
    """column becomes one 0/1 column per value."""
    names = labels or {}
    return df.withColumns(
        {f"{column}{sep}{names.get(v, v)}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values}
    ).drop(column)


def undummies(df: DataFrame, prefix: str, out: str, sep: str = "/", all_zero: str | None = None) -> DataFrame:
    """The label of the largest of the prefix's columns; if all are zero, `all_zero`."""
    own = [c for c in df.columns if c.startswith(prefix + sep)]
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in own])
    label = F.element_at(F.array(*[F.lit(c[len(prefix + sep) :]) for c in own]), F.array_position(values, F.array_max(values)).cast("int"))
    return df.withColumn(out, F.when(F.array_max(values) > 0, label).otherwise(F.lit(all_zero))).drop(*own)


def dummy_groups(df: DataFrame, sep: str = "/") -> dict[str, list[str]]:
    """Prefixes of at least two integer or boolean columns whose values are all 0 or 1; one row
    comes to the driver."""
    own = [c for c, t in df.dtypes if sep in c and t in ("int", "bigint", "boolean", "smallint", "tinyint")]
    if not own:
        return {}
    row = df.agg(*[F.max((~F.col(f"`{c}`").cast("int").isin(0, 1)).cast("int")).alias(c) for c in own]).first()
    groups: dict[str, list[str]] = {}
    for c in own:
        if not row[c]:
            groups.setdefault(c.split(sep)[0], []).append(c)
    return {p: cs for p, cs in groups.items() if len(cs) > 1}


def decode_labels(c: Column, labels: Mapping[object, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), c)


def keep_known(df: DataFrame, known: Sequence[str], new: Sequence[str] = (), removed: Sequence[str] = ()) -> DataFrame:
    """Columns of the dictionary and new ones, without removed ones, in df's order."""
    keep = (set(known) | set(new)) - set(removed)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])


def rename_known(df: DataFrame, names: Mapping[str, str | None]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if b})


def align_columns(real: DataFrame, synthetic: DataFrame, prefix: str = "generated_", drop: Sequence[str] = ("generation_id",)) -> tuple[DataFrame, DataFrame]:
    """Both tables with their common columns in the real order, the prefix stripped."""
    s = synthetic.drop(*drop)
    s = s.withColumnsRenamed({c: c.removeprefix(prefix) for c in s.columns})
    common = [F.col(f"`{c}`") for c in real.columns if c in s.columns]
    return real.select(*common), s.select(*common)


def drop_empty_columns(df: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Without the columns that hold no value; one aggregate."""
    row = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if row[c] == 0 and c not in kept])


def model_frame(
    df: DataFrame, subject: str, time: str, predictors: Sequence[str], cofactors: Sequence[str], exclude: Sequence[str] = (),
    order: Sequence[str] = (), prediction: bool = False,
) -> DataFrame:
    """(ID, TIME, predictors, cofactors): ids as text, numbers coerced, flags as 0/1, one row per
    (ID, TIME), and unless for prediction only subjects with several visits."""
    from visitframe.operators.cleaning import several_visits
    from visitframe.operators.visits import keep_first

    names = [c for c in [*predictors, *cofactors] if c in df.columns and c not in exclude]
    kind = dict(df.dtypes)
    picked = df.select(
        F.col(subject).cast("string").alias("ID"), F.col(time).try_cast("double").alias("TIME"),
        *[(X.bool_like(F.col(f"`{c}`")) if kind[c] == "boolean" else F.col(f"`{c}`").try_cast("double")).alias(c) for c in names],
        *[F.col(c).alias(f"__o_{c}") for c in order],
    ).where("TIME is not null and not isnan(TIME)")
    first = keep_first(picked, ["ID", "TIME"], [f"__o_{c}" for c in order] or names).drop(*[f"__o_{c}" for c in order])
    return first if prediction else several_visits(first, "ID")


def split_frame(df: DataFrame, predictors: Sequence[str], cofactors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Predictors by (ID, TIME) and cofactors by ID, the latter from each subject's first row."""
    first = df.groupBy("ID").agg(*[F.min_by(f"`{c}`", "TIME").alias(c) for c in cofactors])
    return df.select("ID", "TIME", *[F.col(f"`{c}`") for c in predictors]), first


def settings_of(df: DataFrame, column: str, method: str) -> DataFrame:
    """(method, low, high): empirical 1st and 99th percentiles of a column per method."""
    p = F.percentile(column, [0.01, 0.99])
    return df.groupBy(F.coalesce(F.col(method), F.lit("unknown")).alias("method")).agg(p.alias("__p")).select(
        "method", F.get("__p", F.lit(0)).alias("low"), F.get("__p", F.lit(1)).alias("high")
    )


def normalize_fixed(df: DataFrame, scales: Mapping[str, tuple[float, float, str]]) -> DataFrame:
    """[0, 1] by fixed scales, `inverse` ones flipped, cut at the ends; equal bounds are skipped."""
    return df.withColumns(
        {
            c: X.normalize_range(F.col(f"`{c}`"), F.lit(float(a)), F.lit(float(b)), d == "inverse")
            for c, (a, b, d) in scales.items()
            if c in df.columns and a != b
        }
    )


def normalize_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """[0, 1] by the data's own ends, which are one row."""
    ends = df.agg(*[F.min(f"`{c}`").cast("double").alias(f"__lo_{c}") for c in columns], *[F.max(f"`{c}`").cast("double").alias(f"__hi_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(ends)).withColumns(
        {c: X.normalize_range(F.col(f"`{c}`"), F.col(f"`__lo_{c}`"), F.col(f"`__hi_{c}`")) for c in columns}
    )
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def denormalize(df: DataFrame, scales: Mapping[str, tuple[float, float, str]], rounded: bool = True) -> DataFrame:
    return df.withColumns(
        {
            c: X.denormalize_range(F.col(f"`{c}`"), F.lit(float(a)), F.lit(float(b)), d == "inverse", rounded)
            for c, (a, b, d) in scales.items()
            if c in df.columns
        }
    )


def reverse_all(
    df: DataFrame, scales: Mapping[str, tuple[float, float, str]], volumes: Mapping[str, tuple[float, float, str]],
    groups: Mapping[str, str], labels: Mapping[str, Mapping[object, str]],
) -> DataFrame:
    """Scales, volumes, dummies and labels back to where they came from."""
    out = denormalize(denormalize(df, scales), volumes, rounded=False)
    for prefix, name in groups.items():
        out = undummies(out, prefix, name)
    return out.withColumns({c: decode_labels(F.col(c), m) for c, m in labels.items() if c in out.columns})


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = df.agg(*[F.percentile(f"`{c}`", 0.5).alias(f"__m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"`__m_{c}`")) for c in columns}).drop(*m.columns)


def impute_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """median_impute, where only columns with NULLs have their medians looked for: one pass counts these. df is read several times."""
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first() if columns else {}
    gaps = [c for c in columns if nulls[c]]
    whole = {c: F.col(f"`{c}`").cast("double") for c in columns if c not in gaps}
    return (median_impute(df, gaps) if gaps else df).withColumns(whole)


def standardize(df: DataFrame, columns: Sequence[str], of: DataFrame | None = None) -> DataFrame:
    """Zero mean, unit population deviation, measured on `of` (df by default); constant columns keep
    a scale of 1."""
    s = (df if of is None else of).agg(*[F.avg(f"`{c}`").alias(f"__a_{c}") for c in columns], *[F.stddev_pop(f"`{c}`").alias(f"__s_{c}") for c in columns])
    scaled = {
        c: (F.col(f"`{c}`") - F.col(f"`__a_{c}`")) / F.when(F.col(f"`__s_{c}`") == 0, 1.0).otherwise(F.col(f"`__s_{c}`")) for c in columns
    }
    return df.crossJoin(F.broadcast(s)).withColumns(scaled).drop(*s.columns)


def interpolate_at(df: DataFrame, targets: DataFrame, subject: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Columns at the targets' (subject, time), linear between visits and held at the ends. The union is
    sorted once by (subject, time)."""
    rows = df.select(subject, F.col(time).cast("double").alias("__t"), F.struct(F.col(time).cast("double").alias("t"), *columns).alias("__p"), F.lit(0).alias("__s"))
    want = targets.select(subject, F.col(time).cast("double").alias("__t"), F.lit(None).cast(rows.schema["__p"].dataType).alias("__p"), F.lit(1).alias("__s"))
    w = Window.partitionBy(subject).orderBy("__t", "__s")
    back = F.last("__p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = rows.unionByName(want).withColumns({"__b": back, "__a": ahead}).where("__s = 1")
    share = F.try_divide(F.col("__t") - F.col("__b.t"), F.col("__a.t") - F.col("__b.t"))
    out = [
        F.coalesce(F.col(f"__b.{c}") + share * (F.col(f"__a.{c}") - F.col(f"__b.{c}")), F.col(f"__b.{c}"), F.col(f"__a.{c}")).alias(c)
        for c in columns
    ]
    return both.select(subject, F.col("__t").alias(time), *out)


def quantile_map(df: DataFrame, real: DataFrame, column: str, key: str, grid: int = 1001) -> DataFrame:
    """column moved to the real distribution: its empirical share, read off the real quantiles on an
    even grid. The grid is one row of `grid` numbers."""
    from visitframe.operators.stats import running_share

    shares = running_share(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value")))
    q = real.agg(F.percentile(column, [k / (grid - 1) for k in range(grid)]).alias("__q"))
    at = F.col("share") * (grid - 1)
    low = F.floor(at).cast("int")
    value = F.get("__q", low) + (at - low) * (F.get("__q", F.least(low + 1, F.lit(grid - 1))) - F.get("__q", low))
    table = shares.crossJoin(F.broadcast(q)).select(F.col("value").alias("__v"), value.alias("__new"))
    return df.join(table, F.col(column).cast("double") == F.col("__v"), "left").withColumn(column, F.col("__new")).drop("__v", "__new")


def sync_dictionary(dictionary: DataFrame, file_code: str, columns: Sequence[str]) -> DataFrame:
    """The dictionary of a file for the columns it has now: rows of vanished variables go, new ones
    copy the first variable whose code contains the part before / or %. Which code contains which is no
    equi-join, so it is found on the file's list of codes, which like `columns` is a header, not data; the
    rows follow by joins."""
    spark = dictionary.sparkSession
    now = spark.createDataFrame([(c,) for c in columns], "variable_code string")
    own, others = dictionary.where(F.col("file_code") == file_code), dictionary.where(F.col("file_code") != file_code)
    codes = sorted(r[0] for r in own.select("variable_code").distinct().collect() if r[0] is not None)
    kept = own.join(now, "variable_code", "left_semi")
    made = []
    for c in sorted(set(columns) - set(codes)):
        stem = re.split("[/%]", c)[0]
        made.append((c, next((x for x in codes if stem in x), None)))
    new = spark.createDataFrame(made, "__new string, __source string")
    source = own.dropDuplicates(["variable_code"])
    copied = new.join(source, new["__source"] == source["variable_code"], "left").select(
        *[F.lit(file_code).alias(c) if c == "file_code" else F.col("__new").alias(c) if c == "variable_code" else F.col(c) for c in dictionary.columns]
    )
    return others.unionByName(kept.select(*dictionary.columns)).unionByName(copied)


def drop_flagged(df: DataFrame, dictionary: DataFrame, file_code: str, flag: str, kept: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """df without the columns that the dictionary flags `drop` for the file (never the kept ones), and the dictionary
    without their rows. A dictionary without the flag column changes nothing."""
    if flag not in dictionary.columns:
        return df, dictionary
    own = F.col("file_code").eqNullSafe(F.lit(file_code)) & F.coalesce(F.col(flag) == "drop", F.lit(False))
    gone = [r[0] for r in dictionary.where(own).select("variable_code").distinct().collect()]  # names of columns
    pruned = dictionary.where(~(F.col("file_code").eqNullSafe(F.lit(file_code)) & F.coalesce(F.col("variable_code").isin(gone), F.lit(False)))) if gone else dictionary
    return df.drop(*[c for c in gone if c in df.columns and c not in kept]), pruned


def present_columns(columns: Sequence[str], groups: Mapping[str, Sequence[str]], exclude: Sequence[str] = ()) -> list[str]:
    """The columns of the groups, in their order, that are there and aren't excluded."""
    return [c for group in groups.values() for c in group if c in set(columns) - set(exclude)]


def method_of_column(column: str, combination: Mapping[str, object], suffixes: Mapping[str, str]) -> object | None:
    """The method of a combination that a column's name stands for: suffixes map a part of names to a filter."""
    return next((combination.get(key) for part, key in suffixes.items() if part in column), None)


def present_settings(
    settings: Mapping[str, object], columns: Sequence[str], combination: Mapping[str, object] | None = None, suffixes: Mapping[str, str] | None = None
) -> dict[str, object]:
    """Settings of the columns that are there. One that differs by method (a mapping) becomes that of the
    combination's method, else that of `unknown`, else none."""
    out: dict[str, object] = {}
    for column, value in settings.items():
        if column not in columns:
            continue
        if not isinstance(value, Mapping) or suffixes is None:
            out[column] = value
            continue
        method = method_of_column(column, combination or {}, suffixes)
        key = str(method).lower() if method is not None else None
        if key in value or "unknown" in value:
            out[column] = value[key] if key in value else value["unknown"]
    return out


def normalization_settings(
    df: DataFrame, settings: Mapping[str, object], additional: Mapping[str, tuple[float, float]] | None = None, method: str = "METHOD",
    drop_right: bool = False,
) -> DataFrame:
    """(variable, method, low, high): the settings of the columns that are there. A column's setting is (low, high), with a NULL method here,
    or a mapping from methods to such, of which the methods stay that occur in `method`; where `unknown` occurs and the column
    has values under it, its bounds are their 1st and 99th percentiles, else it is left out. `additional` settings replace
    others. With drop_right, of columns of both sides (names that start with L or R) the right ones go. One aggregate for
    the methods and one for all percentiles; the settings themselves are the driver's."""
    chosen = {c: v for c, v in settings.items() if c in df.columns}
    if drop_right and any(c[0] in "LR" for c in chosen):
        chosen = {c: v for c, v in chosen.items() if c[0] != "R"}
    chosen |= {c: v for c, v in (additional or {}).items() if c in df.columns}
    by_method = {c: v for c, v in chosen.items() if isinstance(v, Mapping)}
    rows = [(c, None, float(v[0]), float(v[1])) for c, v in chosen.items() if c not in by_method]
    if by_method:
        names = sorted({m for v in by_method.values() for m in v} | {"unknown"})
        here = {r[0] for r in df.where(F.col(method).isin(names)).select(method).distinct().collect()}  # of the settings' methods
        ends = {}
        if "unknown" in here:
            ends = df.where(F.col(method) == "unknown").agg(*[F.percentile(f"`{c}`", [0.01, 0.99]).alias(c) for c in by_method]).first().asDict()
        for c, v in by_method.items():
            rows += [(c, m, float(lo), float(hi)) for m, (lo, hi) in v.items() if m in here and m != "unknown"]
            if ends.get(c) is not None:
                rows.append((c, "unknown", *ends[c]))
    return df.sparkSession.createDataFrame(rows, "variable string, method string, low double, high double")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Feature columns: all numeric ones but ids, times and others to exclude."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def feature_kinds(real: DataFrame, synthetic: DataFrame, features: Sequence[str], categorical: Sequence[str] | None = None, many: int = 20) -> DataFrame:
    """(variable, kind, warning) of the common features: categorical (text or flags in either table, or as given), else
    numeric if numbers in both. A given categorical one that is a number in both with over `many` distinct values is
    warned of."""
    sides = [{f.name: f.dataType for f in t.schema.fields} for t in (real, synthetic)]
    number = {c: all(isinstance(s.get(c), NumericType) for s in sides) for c in features}
    named = [c for c in features if any(isinstance(s.get(c), StringType | BooleanType) for s in sides)] if categorical is None else [c for c in categorical if c in features]
    counted = [c for c in named if number[c]]
    most = {}
    if counted:
        rows = [t.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in counted]).first() for t in (real, synthetic)]
        most = {c: max(r[c] for r in rows) for c in counted}
    out = [(c, "categorical", most.get(c, 0) > many) for c in named] + [(c, "numeric", False) for c in features if number[c] and c not in named]
    return real.sparkSession.createDataFrame(out, "variable string, kind string, warning boolean")


def clone_dictionary(dictionary: DataFrame, existing: DataFrame, statistics: Sequence[str]) -> DataFrame:
    """existing plus the file codes it lacks, with blank statistics."""
    fresh = dictionary.join(existing.select("file_code").distinct(), "file_code", "left_anti")
    blank = fresh.withColumns({c: F.lit(None).cast(dict(dictionary.dtypes)[c]) for c in statistics})
    return existing.unionByName(blank.select(*existing.columns))


def metadata_lists(dictionary: DataFrame, kind: str) -> DataFrame:
    """(file_code, kind, variables): sorted variables of each class of metadata."""
    return dictionary.where(F.col(kind).isNotNull()).groupBy("file_code", F.col(kind).alias("kind")).agg(
        F.array_join(F.array_sort(F.collect_set("variable_code")), ",").alias("variables")
    )
