"""Orchestrated validation of a synthetic table: one tidy row per test and variable."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.operators import cleaning, encoding, ordering, privacy, profiling, splitting, stats, timeseries
from visitframe.session import materialize

RESULT = "test string, variable string, metric string, value double, threshold double, passed boolean"


def _row(df: DataFrame, test: str, metric: str, threshold: float | None, passed=None, variable=None) -> DataFrame:
    """A row per row of df; without a threshold one that only tells."""
    passed = F.lit(None).cast("boolean") if passed is None else passed
    v = F.lit(variable).cast("string") if variable is None or isinstance(variable, str) else variable
    return df.select(
        F.lit(test).alias("test"), v.alias("variable"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"), passed.alias("passed"),
    )


def fidelity(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """KS, chi-square and correlation tests."""
    ks = stats.ks_statistic(real, synthetic, numeric)
    p = stats.ks_p_value(F.col("statistic"), F.col("n_real"), F.col("n_synthetic"))
    rows = [_row(ks.withColumn("p_value", p), "ks", "p_value", 0.05, F.col("p_value") > 0.05, F.col("variable"))]
    for c in categorical:
        found = stats.chi_square(real, synthetic, c).first()  # one row
        value = stats.chi_square_p(found["statistic"], found["degrees"])
        one = real.sparkSession.createDataFrame([(value,)], "p_value double")
        rows.append(_row(one, "chi_square", "p_value", 0.05, F.col("p_value") > 0.05, c))
    corr = materialize(stats.correlation_distance(real, synthetic, numeric))  # one row
    rows.append(_row(corr, "correlation", "mad", 0.15, F.col("mad") < 0.15))
    rows.append(_row(corr, "correlation", "meta_correlation", 0.8, F.col("meta_correlation") > 0.8))
    return reduce(DataFrame.unionByName, rows)


def forest_scores(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, trees: int = 100, seed: int = 42) -> tuple[float, float]:
    """Accuracy and macro F1, over all classes that occur or are predicted, of a random forest; the confusion counts come to the driver."""
    stages = [
        StringIndexer(inputCol=target, outputCol="__y", handleInvalid="keep"),
        VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip"),
        RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, seed=seed),
    ]
    ready = [df.withColumn(target, F.col(target).cast("string")).dropna(subset=list(features)) for df in (train, test)]
    model = Pipeline(stages=stages).fit(ready[0])
    names = dict(enumerate(model.stages[0].labels))
    rows = model.transform(ready[1]).groupBy(F.col(target).alias("y"), "prediction").count().collect()
    cells = [(r["y"], names.get(int(r["prediction"])), r["count"]) for r in rows]
    f1 = []
    for c in {y for y, _, _ in cells} | {p for _, p, _ in cells}:
        hit, said, true = (sum(n for y, p, n in cells if ok(y == c, p == c)) for ok in (lambda y, p: y and p, lambda y, p: p, lambda y, p: y))
        f1.append(2 * hit / (said + true))
    return sum(n for y, p, n in cells if y == p) / max(sum(n for _, _, n in cells), 1), sum(f1) / max(len(f1), 1)


def utility(real: DataFrame, synthetic: DataFrame, subject: str, features: Sequence[str], target: str, trees: int = 100, share: float = 0.7) -> DataFrame:
    """Train on synthetic against train on real, both tested on the same real subjects. A fit and a test read their rows many times, so the columns
    in use are computed once and kept."""
    used = list(dict.fromkeys([subject, *features, target]))
    real, synthetic = (materialize(encoding.impute_gaps(materialize(df.select(*used)), features)) for df in (real, synthetic))
    parts = splitting.stratified_subjects(real, subject, share, least_one=True).select(subject, "part")
    tagged = materialize(real.join(parts, subject))
    train, test = (tagged.where(F.col("part") == p).drop("part") for p in ("train", "validation"))
    ts, tr = forest_scores(synthetic, test, features, target, trees), forest_scores(train, test, features, target, trees)
    rows = []
    for k, name in enumerate(("accuracy", "macro_f1")):
        loss = tr[k] - ts[k]
        rows += [
            ("utility", target, f"tstr_{name}", ts[k], None, None),
            ("utility", target, f"trtr_{name}", tr[k], None, None),
            ("utility", target, f"{name}_degradation", loss, 0.05, loss < 0.05),
        ]
    return real.sparkSession.createDataFrame(rows, RESULT)


def _coded(real: DataFrame, synthetic: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with a number in place of each value of the column; NULL is a value of its own."""
    values = real.select(column).unionByName(synthetic.select(column)).where(F.col(column).isNotNull()).distinct()
    codes = materialize(ordering.global_index(values, [column], "__code"))
    one, other = (t.join(codes, column, "left").withColumn(column, F.coalesce(F.col("__code") + 1, F.lit(0))).drop("__code") for t in (real, synthetic))
    return one, other


def privacy_tests(real: DataFrame, synthetic: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Identical rows, the closest records by the numbers, and maximum similarities over numbers and categories."""
    same = materialize(privacy.identical_share(real, synthetic, [*numeric, *categorical]))
    near = materialize(privacy.closest_record_ratio(real, synthetic, numeric, key, order=key))
    sides = real, synthetic
    for c in categorical:
        sides = _coded(*sides, c)
    sides = [materialize(t) if categorical else t for t in sides]
    most = materialize(privacy.similarity_tests(*sides, key, [*numeric, *categorical], categorical))
    return reduce(
        DataFrame.unionByName,
        [
            _row(same, "identical_match", "share", 0, F.col("share") == 0),
            _row(near, "closest_record", "ratio", 0.5, F.col("ratio") <= 0.5),
            _row(most, "maximum_similarity", "quality", 1, F.col("quality") <= 1),
            _row(most, "maximum_similarity", "p_value", 0.05, F.col("p_value") > 0.05),
        ],
    )


def pre_checks(real: DataFrame, synthetic: DataFrame, subject: str, numeric: Sequence[str], target: str | None = None) -> DataFrame:
    """Columns and their types, sizes, visits per subject, classes of a target, NULLs and ranges. The last row counts what the checks call critical:
    missing columns, less than 0.3 of the real rows, missing classes."""
    problems = profiling.schema_check(real, synthetic)
    schema = []
    for kind in ("missing", "extra", "type"):
        found = [c for c, p in problems if p == kind]
        schema += [("schema", c, kind, 1.0, 0.0, False) for c in found] or [("schema", None, kind, 0.0, 0.0, True)]
    if set(real.columns) == set(synthetic.columns):
        moved = sum(a != b for a, b in zip(real.columns, synthetic.columns, strict=True))
        schema.append(("schema", None, "moved", float(moved), 0.0, moved == 0))
    ratio = F.coalesce(F.try_divide("s", "r"), F.lit(0.0))
    one = real.agg(F.count("*").alias("r")).crossJoin(F.broadcast(synthetic.agg(F.count("*").alias("s")))).select(ratio.alias("ratio"))
    critical = F.lit(int(any(p == "missing" for _, p in problems))) + (profiling.size_verdict(F.col("ratio")) == "issue").cast("int")
    if target:
        shares = profiling.class_shares(*(t.where(F.col(target).isNotNull()) for t in (real, synthetic)), target)
        classes = shares.agg(
            F.max(F.when(F.col("real_share").isNotNull(), F.col("difference"))).alias("difference"),
            F.count_if(F.col("synthetic_share").isNull()).alias("missing"), F.count_if(F.col("real_share").isNull()).alias("extra"),
        )
        one = one.crossJoin(F.broadcast(classes))
        critical = critical + (F.col("missing") > 0).cast("int")
    one = materialize(one.withColumn("critical", critical))  # one row
    parts = [
        real.sparkSession.createDataFrame(schema, RESULT),
        _row(one, "size", "ratio", 0.5, F.col("ratio") >= 0.5),
        _row(one, "size", "ratio", 2, F.col("ratio") <= 2),
    ]
    shape = materialize(profiling.longitudinal_check(real, synthetic, subject))  # one row
    parts += [
        _row(shape, "longitudinal", "subjects_difference", 0.3, F.col("subjects_ok")),
        _row(shape, "longitudinal", "visits_difference", 0.4, F.col("visits_ok")),
    ]
    if target:
        parts += [
            _row(one, "classes", "difference", 0.1, F.col("difference") <= 0.1, target),
            _row(one, "classes", "missing", 0, F.col("missing") == 0, target),
            _row(one, "classes", "extra", 0, F.col("extra") == 0, target),
        ]
    nulls = profiling.null_rate_difference(real, synthetic, [c for c in real.columns if c in synthetic.columns])
    parts.append(_row(nulls, "nulls", "difference", 15, ~F.col("too_large"), F.col("variable")))
    beyond = F.greatest(F.col("real_min") - F.col("synthetic_min"), F.col("synthetic_max") - F.col("real_max"), F.lit(0.0))
    share = F.when(beyond == 0, 0.0).otherwise(F.try_divide(beyond, F.col("real_max") - F.col("real_min")))
    ranges = profiling.range_check(real, synthetic, numeric).withColumn("beyond", share)
    parts += [_row(ranges, "range", "beyond", 0.2, F.col("inside"), F.col("variable")), _row(one, "pre_check", "critical", 0, F.col("critical") == 0)]
    return reduce(DataFrame.unionByName, parts)


def temporal(real: DataFrame, synthetic: DataFrame, subject: str, time: str, numeric: Sequence[str]) -> DataFrame:
    """Unit roots, stationarity and orders of every number's series, real against synthetic. A column without series that are long enough on
    both sides has NULLs."""
    tests = timeseries.tests_of_columns(real, synthetic, subject, time, numeric)
    every = real.sparkSession.createDataFrame([(c,) for c in numeric], "variable string")
    parts = []
    for name in ("adf", "kpss"):
        found = every.join(materialize(timeseries.compare_stationarity(*tests[name], by=["variable"])), "variable", "left")
        found = found.withColumn("difference", F.abs(F.col("real") - F.col("synthetic")))
        parts.append(_row(found, name, "difference", 20, F.col("verdict") == "pass", F.col("variable")))
        for side in ("real", "synthetic"):
            parts.append(_row(found, name, side, None, variable=F.col("variable")))
    orders = every.join(materialize(timeseries.compare_orders(*tests["orders"], by=["variable"])), "variable", "left")
    for name in ("ar", "ma"):
        found = orders.withColumnsRenamed({f"real_{name}": "real", f"synthetic_{name}": "synthetic"})
        found = found.withColumn("difference", F.abs(F.col("real") - F.col("synthetic")))
        parts.append(_row(found, f"{name}_order", "difference", 0, F.col("difference") == 0, F.col("variable")))
        for side in ("real", "synthetic"):
            parts.append(_row(found, f"{name}_order", side, None, variable=F.col("variable")))
    return reduce(DataFrame.unionByName, parts)


def full_report(
    real: DataFrame, synthetic: DataFrame, key: str, subject: str, numeric: Sequence[str], categorical: Sequence[str], target: str | None = None,
    time: str | None = None,
) -> DataFrame:
    """Pre-checks, fidelity, privacy with maximum similarities, with a target utility, and with a time the tests of series. Rows are computed
    once, since every part reads them."""
    real, synthetic = (materialize(t) for t in (real, synthetic))
    features = [c for c in numeric if c != time]
    # parts are a few rows a column, each computed by itself: all plans at once would fill the driver
    parts = [
        materialize(pre_checks(real, synthetic, subject, features, target)),
        materialize(fidelity(real, synthetic, numeric, categorical)),
        materialize(privacy_tests(real, synthetic, key, numeric, categorical)),
    ]
    if target:
        parts.append(utility(real, synthetic, subject, [c for c in numeric if c != target], target))
    if time:
        parts.append(materialize(temporal(real, synthetic, subject, time, features)))
    return reduce(DataFrame.unionByName, parts)


def age_matched(real: DataFrame, synthetic: DataFrame, key: str, age: str, tolerance_percent: float = 5) -> tuple[DataFrame, DataFrame]:
    """Synthetic rows in the real range of ages, and the real table, cut to their number where it is much larger. Without an age in
    both tables all ages count."""
    if age in real.columns and age in synthetic.columns:
        synthetic = cleaning.within_range_of(synthetic, real, age, tolerance_percent)
    return cleaning.balance_sizes(real, synthetic, [key]), synthetic


def validate(
    real: DataFrame, synthetic: DataFrame, key: str, subject: str, numeric: Sequence[str], categorical: Sequence[str], mode: str = "full",
    target: str | None = None, age: str = "AGE", tolerance_percent: float = 5, align: bool = True,
    utility_real: DataFrame | None = None, utility_synthetic: DataFrame | None = None, time: str | None = None,
) -> DataFrame:
    """Align, check and validate. Modes: `full` (full_report); `age_matching`: synthetic rows with an age in the real range, `tolerance_percent` of
    its span wider on both sides, a real table that is much larger cut to their number, then fidelity of the numbers alone;
    `utility`: train on synthetic, test on real alone, on tables of their own if given. align=False takes
    the tables as they are. Tests over columns that alignment dropped are left out."""
    if mode not in ("full", "age_matching", "utility"):
        raise ValueError(f"no mode {mode}")
    if align:
        real, synthetic = encoding.align_columns(real, synthetic)
    numeric, categorical = ([c for c in names if c in real.columns and c in synthetic.columns] for names in (numeric, categorical))
    if mode == "utility":
        if target is None:
            raise ValueError("the utility mode needs a target")
        return utility(real if utility_real is None else utility_real, synthetic if utility_synthetic is None else utility_synthetic, subject, numeric, target)
    if mode == "age_matching":
        return fidelity(*age_matched(real, synthetic, key, age, tolerance_percent), numeric, [])
    return full_report(real, synthetic, key, subject, numeric, categorical, target, time)


def fidelity_verdict(report: DataFrame) -> DataFrame:
    """One row: share of passed tests and what it stands for."""
    share = report.where("passed is not null").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return share.withColumn("verdict", F.when(F.col("pass_rate") >= 0.8, "excellent").when(F.col("pass_rate") >= 0.6, "acceptable").otherwise("poor"))
