"""Series by blocks against whole series in memory, for blocks of every size."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests import series_plain as plain
from visitframe.operators import ordering, timeseries
from visitframe.session import materialize

SCHEMA = "s long, t long, v double"


def made(seed: int) -> dict[int, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {k: rng.normal(size=int(rng.integers(8, 60))) for k in range(12)}
    for k in range(12, 20):
        y = np.zeros(int(rng.integers(30, 150)))
        for i in range(1, len(y)):
            y[i] = rng.choice([0.3, 0.9]) * y[i - 1] + rng.normal()
        out[k] = y + 1000
    out[30] = np.cumsum(rng.normal(size=200))  # holds a third of all rows
    out[31] = np.full(20, 3.0)
    return out


def table(spark, series: dict[int, np.ndarray]):
    rows = [(s, 7 * i, float(x)) for s, y in series.items() for i, x in enumerate(y)]
    rows += [(None, 1, 2.0), (1, 10**6, None), (1, 10**6, math.nan)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(params=[4096, 40, 17])
def block(request, monkeypatch):
    monkeypatch.setattr(timeseries, "BLOCK", request.param)
    return request.param


def near(got, want) -> bool:
    return all((g is None and (w is None or math.isnan(w))) or (g is not None and math.isclose(g, w, rel_tol=1e-6, abs_tol=1e-8)) for g, w in zip(got, want, strict=True))


def check(found, series, test, names, least):
    got = {r["s"]: [r[c] for c in names] for r in found.collect()}
    assert sorted(got) == sorted(s for s, y in series.items() if len(y) >= least)
    for s, own in got.items():
        if s == 31:
            assert own == [None] * len(names)
        else:
            assert near(own, test(series[s])), (s, own, test(series[s]))


def test_unit_roots(spark, block):
    series = made(1)
    check(timeseries.adf_per_subject(table(spark, series), "s", "t", "v"), series, plain.adf, ["statistic", "p_value", "lags"], 8)


def test_stationarity(spark, block):
    series = made(2)
    check(timeseries.kpss_per_subject(table(spark, series), "s", "t", "v"), series, plain.kpss, ["statistic", "p_value", "lags"], 3)


def test_orders(spark, block):
    series = made(3)
    check(timeseries.orders_per_subject(table(spark, series), "s", "t", "v"), series, plain.orders, ["ar_order", "ma_order"], 10)


def test_autocorrelations(spark, block):
    series = made(4)
    df = table(spark, series)
    names = [f"pacf{k}" for k in (1, 2, 3)]
    check(timeseries.pacf_per_subject(df, "s", "t", "v"), series, lambda y: plain.pacf(y, 3)[1:], names, 10)
    got = {r["s"]: (r["acf1"], r["acf2"]) for r in timeseries.acf_columns(df, "s", "t", "v", 2).collect()}
    assert all(near(got[s], plain.acf(y, 2)[1:]) for s, y in series.items() if s != 31)


def test_a_long_series_is_spread_over_blocks(spark, monkeypatch):
    """The rows that one group holds are bounded by the block and the largest lag."""
    monkeypatch.setattr(timeseries, "BLOCK", 64)
    sizes = []
    plain_blocks = timeseries.by_blocks

    def watched(values, info, halo, sums):
        def counted(info, block, pos, v, own):
            return [("rows", block, float(len(v)))]

        sizes.append((max(r["value"] for r in plain_blocks(values, info, halo, counted).collect()), halo))
        return plain_blocks(values, info, halo, sums)

    monkeypatch.setattr(timeseries, "by_blocks", watched)
    series = {1: np.random.default_rng(5).normal(size=3000), 2: np.arange(10.0)}
    timeseries.adf_per_subject(table(spark, series), "s", "t", "v").collect()
    assert sizes and all(rows <= max(64, halo) + halo for rows, halo in sizes)


def test_places_in_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), int(t)) for g, t in zip(rng.choice([1, 2, 3], 500, p=[0.8, 0.1, 0.1]), rng.permutation(500), strict=True)]
    got = ordering.place_in_group(spark.createDataFrame(rows, "g int, t int"), "g", ["t"], "at").collect()
    assert len(got) == 500
    for g in (1, 2, 3):
        own = sorted((r["t"], r["at"]) for r in got if r["g"] == g)
        assert [at for _, at in own] == list(range(len(own)))


def test_a_join_broadcast_at_run_time_splits_no_group(spark):
    """A join that adaptive execution turns into a broadcast reads its shuffle where it lies; groups have to be dealt again behind it."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 4000, 1, 4).selectExpr("id % 500 as s", "id as k")
        known = materialize(spark.range(500).selectExpr("id as s", "true as v"))
        sizes = timeseries.in_groups(rows.join(known, "s"), ["s"], ["k"], lambda g: [(int(g["s"][0]), len(g["k"]))], "s long, n long").collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted(tuple(r) for r in sizes) == [(s, 8) for s in range(500)]
