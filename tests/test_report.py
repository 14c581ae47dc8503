"""The whole report of a synthetic table: every step is in it, and its rows are those of the single tests and of plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.conftest import SMALL
from visitframe.operators import privacy, timeseries, validation

SCHEMA = "row long, s long, t long, x double, y double, c string, d string"


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(8)

    def table(no: int, moves: float):
        walk = np.cumsum(rng.normal(size=(8, 30)), axis=1) * moves + rng.normal(size=(8, 30))
        rows = [(no + 30 * s + t, s, t, float(walk[s, t]), None if t % 9 == no % 2 else float(rng.normal()), "ab"[t % 2], ["p", "q", None][s % 3]) for s in range(8) for t in range(30)]
        return spark.createDataFrame(rows, SCHEMA)

    return table(0, 1.0), table(1001, 0.0)


@pytest.fixture(scope="module")
def report(sides):
    rows = validation.full_report(*sides, "row", "s", ["x", "y"], ["c", "d"], target="c", time="t").collect()
    found = {(r["test"], r["variable"], r["metric"], r["threshold"]): r for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_step_is_reported(report):
    steps = {
        "schema", "size", "longitudinal", "classes", "nulls", "range", "pre_check", "ks", "chi_square", "correlation", "identical_match", "closest_record",
        "maximum_similarity", "utility", "adf", "kpss", "ar_order", "ma_order",
    }
    assert {test for test, *_ in report} == steps
    for test in ("adf", "kpss", "ar_order", "ma_order", "range"):
        assert {v for t, v, *_ in report if t == test} == {"x", "y"}
    assert {v for t, v, *_ in report if t == "nulls"} == {"row", "s", "t", "x", "y", "c", "d"}
    assert {m for t, _, m, _ in report if t == "maximum_similarity"} == {"quality", "p_value"}


def test_the_registered_report_has_utility_and_series(spark, monkeypatch):
    from visitframe.plans import validation_queries

    asked = {}

    def keep(real, synthetic, key, subject, numeric, categorical, target=None, time=None):
        asked.update(target=target, time=time, columns=set(real.columns), numeric=numeric)
        return spark.createDataFrame([], validation.RESULT)

    monkeypatch.setattr(validation, "full_report", keep)
    validation_queries.validation_report(spark, SMALL)
    assert {asked["target"], asked["time"]} <= asked["columns"] and len(asked["numeric"]) == 64
    assert asked["target"] not in asked["numeric"] and asked["time"] not in asked["numeric"]


def test_series_of_columns_are_those_of_single_columns(sides, report):
    for name, single in (("adf", timeseries.adf_per_subject), ("kpss", timeseries.kpss_per_subject)):
        for c in ("x", "y"):
            want = timeseries.compare_stationarity(*(single(t, "s", "t", c) for t in sides)).first()
            real, synthetic = (report[name, c, side, None]["value"] for side in ("real", "synthetic"))
            assert (real, synthetic) == (want["real"], want["synthetic"])
            gap = report[name, c, "difference", 20.0]
            assert gap["value"] == abs(real - synthetic) and gap["passed"] == (want["verdict"] == "pass")
    assert report["adf", "x", "real", None]["value"] < 50 < report["adf", "x", "synthetic", None]["value"] and not report["adf", "x", "difference", 20.0]["passed"]
    for c in ("x", "y"):
        want = timeseries.compare_orders(*(timeseries.orders_per_subject(t, "s", "t", c) for t in sides)).first()
        for k in ("ar", "ma"):
            assert [report[f"{k}_order", c, side, None]["value"] for side in ("real", "synthetic")] == [want[f"{side}_{k}"] for side in ("real", "synthetic")]
            assert report[f"{k}_order", c, "difference", 0.0]["passed"] == (want[f"real_{k}"] == want[f"synthetic_{k}"])


def test_columns_with_short_series_have_nulls(spark):
    rows = [(k, k % 3, k, float(k * k % 7), None if k % 3 else float(k)) for k in range(12)]
    df = spark.createDataFrame(rows, "row long, s long, t long, x double, y double")
    found = {(r["test"], r["variable"], r["metric"]): r for r in validation.temporal(df, df, "s", "t", ["x", "y"]).collect()}
    assert len(found) == 4 * 3 * 2
    assert all(found[test, "x", m]["value"] is None and found[test, "x", m]["passed"] is None for test in ("adf", "ar_order", "ma_order") for m in ("real", "difference"))
    assert found["kpss", "x", "difference"]["passed"] and found["kpss", "y", "real"]["value"] is not None


def test_similarities_count_categories(sides, report):
    every = [[r.asDict() for r in t.collect()] for t in sides]
    tables = [[r for r in t if r["y"] is not None] for t in every]

    def spans(rows):
        return {c: np.ptp([r[c] for r in rows if r[c] is not None]) for c in ("x", "y")}

    def most(queries, base, ranges):
        def near(q, b):
            return (sum(1 - abs(q[c] - b[c]) / ranges[c] for c in ("x", "y")) + (q["c"] == b["c"]) + (q["d"] == b["d"])) / 4

        return np.array([max(near(q, b) for b in base if b is not q) for q in queries])

    rr, ss = (most(t, t, spans(e)) for t, e in zip(tables, every, strict=True))
    cross = most(tables[1], tables[0], spans(every[0] + every[1]))
    assert math.isclose(report["maximum_similarity", None, "quality", 1.0]["value"], cross.mean() / rr.mean())
    steps = np.concatenate([rr, ss])
    gap = max(abs((rr <= v).mean() - (ss <= v).mean()) for v in steps)
    root = math.sqrt(len(rr) * len(ss) / (len(rr) + len(ss)))
    z = (root + 0.12 + 0.11 / root) * gap
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    got = report["maximum_similarity", None, "p_value", 0.05]
    assert math.isclose(got["value"], min(max(p, 0.0), 1.0), abs_tol=1e-6) and got["passed"] == (got["value"] > 0.05)


def test_maximum_similarity_keeps_its_columns(sides):
    found = privacy.maximum_similarity(*sides, "row", ["x"])
    assert found.columns == ["within_real", "within_synthetic", "across", "ks_synthetic", "ks_across", "quality"]


def test_pre_checks_find_what_is_wrong(spark):
    real = spark.createDataFrame([(s, float(k), "abc"[k % 3], k) for s in range(4) for k in range(10)], "s long, x double, c string, gone int")
    synthetic = spark.createDataFrame([(0, 5.0, "a", 1)] * 5 + [(1, 99.0, "z", 1)] + [(1, None, "a", 1)] * 4, "s string, x double, c string, new int")
    found = {(r["test"], r["variable"], r["metric"], r["threshold"]): (r["value"], r["passed"]) for r in validation.pre_checks(real, synthetic, "s", ["x"], "c").collect()}
    assert found["schema", "gone", "missing", 0.0] == found["schema", "new", "extra", 0.0] == found["schema", "s", "type", 0.0] == (1.0, False)
    assert found["size", None, "ratio", 0.5] == (0.25, False) and found["size", None, "ratio", 2.0] == (0.25, True)
    assert found["classes", "c", "missing", 0.0] == (2.0, False) and found["classes", "c", "extra", 0.0] == (1.0, False)
    value, passed = found["classes", "c", "difference", 0.1]
    assert math.isclose(value, 0.9 - 0.4) and passed is False
    assert found["nulls", "x", "difference", 15.0] == (40.0, False) and found["nulls", "c", "difference", 15.0] == (0.0, True)
    assert found["range", "x", "beyond", 0.2] == (10.0, False)
    assert found["pre_check", None, "critical", 0.0] == (3.0, False)
    same = {(r["test"], r["metric"]): r["passed"] for r in validation.pre_checks(real, real, "s", ["x"], "c").collect()}
    assert all(same.values()) and ("schema", "moved") in same


def test_rows_with_nulls_are_tested_and_learned_from(spark, monkeypatch):
    rows = [(k, k % 20, None if k % 4 == 0 else float(k % 2), float(k), str(k % 2)) for k in range(200)]
    df = spark.createDataFrame(rows, "row long, s long, x double, z double, y string")
    seen = []

    def keep(train, test, features, target, *rest):
        seen.append((train.count(), test.count(), train.where("x is null").count() + test.where("x is null").count()))
        return 1.0, 1.0

    monkeypatch.setattr(validation, "forest_scores", keep)
    validation.utility(df, df, "s", ["x", "z"], "y")
    assert seen == [(200, 60, 0), (140, 60, 0)]


def test_macro_f1_is_over_all_classes(spark):
    train = spark.createDataFrame([(float(k % 2), "ab"[k % 2]) for k in range(100)], "x double, y string")
    test = spark.createDataFrame([(0.0, "a"), (0.0, "a"), (1.0, "a"), (0.0, "new"), (0.0, "other")], "x double, y string")
    accuracy, f1 = validation.forest_scores(train, test, ["x"], "y", trees=5)
    # of a: 2 hits, 4 predicted, 3 there; b is predicted once and never there; two classes are never predicted
    assert accuracy == 0.4 and math.isclose(f1, (4 / 7 + 0 + 0 + 0) / 4)
