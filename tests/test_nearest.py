"""Blocks of rows that meet: bounds hold, few pairs are compared in full, and what comes out is what loops over all pairs give."""

from __future__ import annotations

import numpy as np
import pytest

from visitframe.operators import matching, nearest, privacy


def _plain(metric, flags, scale, u, v):
    if metric == "euclidean":
        return np.sqrt(np.cumsum((u - v) ** 2)[-1])
    off = np.where(flags, u != v, np.abs(u - v) / scale)
    return np.cumsum(off)[-1] / len(flags)


@pytest.mark.parametrize("metric", ["euclidean", "gower"])
def test_a_bound_never_rules_out_a_pair_within_reach(metric):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(400, 8)), rng.standard_cauchy((400, 4)), rng.exponential(size=(400, 3)) ** 3, np.full(400, 7.0), 1e6 + rng.normal(size=400), rng.integers(-3, 40, (400, 3)) / 2])
    flags = np.arange(x.shape[1]) >= x.shape[1] - 3
    scale = np.where(x.max(0) > x.min(0), x.max(0) - x.min(0), 1.0)
    bound = nearest.Bound(metric, flags, scale, x.mean(0), x.std(0))
    base, asks = bound.base(x), bound.query(x)
    longest = float(-2 * base[:, -1].min())
    for i in range(len(x)):
        distance = np.array([_plain(metric, flags, scale, x[i], v) for v in x])
        ruled_out = asks[i : i + 1] @ base.T < bound.need(np.repeat(asks[i : i + 1], len(x), axis=0), longest, distance).astype(np.float32)
        assert not ruled_out.any()


def test_few_pairs_are_compared_in_full(monkeypatch):
    rng = np.random.default_rng(5)
    x, flags, seen, plain = rng.normal(size=(8000, 64)), np.zeros(64, bool), [], nearest.Bound.distance
    monkeypatch.setattr(nearest.Bound, "distance", lambda self, u, v: seen.append(len(u)) or plain(self, u, v))
    for metric, share in (("gower", 0.1), ("euclidean", 0.01)):
        seen.clear()
        bound = nearest.Bound(metric, flags, x.max(0) - x.min(0), x.mean(0), x.std(0))
        rows, *_ = nearest.nearest_of_blocks(bound, x[:512], x[512:], np.full(512, -1), 1, False)
        assert (rows == np.arange(512)).all() and sum(seen) < share * 512 * 7488


@pytest.mark.parametrize("metric", ["euclidean", "gower"])
@pytest.mark.parametrize("same_id", [True, False])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, metric, same_id):
    """Over several blocks of either side, with equal rows, ties, NULLs, NaN, text ids and categories."""
    monkeypatch.setattr(nearest, "LEAST_BLOCK", 40)
    monkeypatch.setattr(nearest.nearest_in_grid, "__defaults__", (True, False, 50, 60))
    rng = np.random.default_rng(6)
    names, flags = [f"c{i}" for i in range(18)], np.arange(18) >= 16
    x = np.column_stack([rng.integers(0, 3, (160, 16)) * 0.1, rng.integers(0, 3, (160, 2))]).astype(float)
    x[150:] = x[0]
    x[3, 0] = -0.0
    rows = [(f"r{i:03d}", *map(float, x[i])) for i in range(160)] + [("null", None, *map(float, x[0, 1:])), ("nan", float("nan"), *map(float, x[0, 1:]))]
    df = spark.createDataFrame(rows, ", ".join(["id string", *[f"{c} double" for c in names]])).repartition(3)
    scale = np.where(flags, 1.0, 0.2)
    found = matching.blocked_nearest(df.where("id < 'r090' or id > 'r140'"), df, "id", names, 3, metric, [c for c, f in zip(names, flags, strict=True) if f], dict(zip(names, scale, strict=True)), same_id)
    got = {(r["query_id"], r["rank"]): (r["base_id"], r["distance"]) for r in found.collect()}
    asked = [i for i in range(160) if i < 90 or i > 140]
    assert len(got) == 3 * len(asked)
    for i in asked:
        want = sorted((_plain(metric, flags, scale, x[i], x[j]), f"r{j:03d}") for j in range(160) if same_id or j != i)[:3]
        assert [got[f"r{i:03d}", k + 1] for k in range(3)] == [(name, d) for d, name in want]


def test_many_dimensions_move_no_copies_of_queries(spark):
    """A pair of blocks is met where the blocks are kept: rows move to their block once."""
    df = spark.range(600).selectExpr("id", *[f"rand({i}) AS c{i}" for i in range(20)])
    plan = matching.blocked_nearest(df, df, "id", [f"c{i}" for i in range(20)], 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan


def test_spans_are_those_of_an_aggregate(spark):
    df = spark.createDataFrame([(1.0, None, 3), (4.5, None, 10), (None, None, -2)], "a double, b double, c int")
    assert privacy._spans(df, ["a", "b"]) == {"a": 3.5, "b": None} and privacy._spans(df, ["a", "c"]) == {"a": 3.5, "c": 12.0}
    assert privacy._spans(df, []) == {} and privacy._spans(df.limit(0), ["a", "b"]) == {"a": None, "b": None}
