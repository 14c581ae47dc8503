"""The merge scenario, and properties of matching."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest

from visitframe.operators import matching as M
from visitframe.operators import visits as V

BASE = dt.date(2020, 1, 15)


def day(n: int) -> dt.date:
    return BASE + dt.timedelta(days=n)


@pytest.fixture
def scenario(spark):
    volumes = [
        (1, 1001, day(0), "bl", "complete", 3.0, 1.0, 1.0), (2, 1001, day(0), "bl", "partial", 3.0, None, None),
        (3, 1002, day(0), "bl", "complete", 3.0, 2.0, 2.0), (4, 1002, day(0), "bl", "partial", 2.5, 2.0, None), (5, 1002, day(0), "bl", "partial", 2.0, None, None),
        (6, 1003, day(30), "m01", "complete", 3.0, 3.0, 3.0), (7, 1004, day(60), "m02", "complete", 3.0, 4.0, 4.0), (8, 1005, day(180), "m06", "complete", 3.0, 5.0, 5.0),
    ]
    scales = [
        (101, 1001, day(0), "bl", 30.0), (102, 1002, day(0), "bl", 29.0), (103, 1003, day(30), "m01", 28.0), (104, 1004, day(75), "m02", 27.0),
        (105, 1005, day(200), "m12", 26.0), (106, 3001, day(45), "m01", 25.0), (107, 3002, day(45), "m01", 24.0),
    ]
    v = spark.createDataFrame(volumes, "row_id long, rid long, visit date, code string, status string, strength double, ventricles double, hippocampus double")
    s = spark.createDataFrame(scales, "row_id long, rid long, visit date, code string, mmse double")
    return v, s


def test_matches_before_dedup(scenario):
    v, s = scenario
    m = {(r.subject, r.kind, r.cardinality) for r in M.cardinality(M.match_visits(v, s, "rid", "visit")).collect()}
    assert m == {(1001, "exact", "N:1"), (1002, "exact", "N:1"), (1003, "exact", "1:1"), (1004, "buffer", "1:1"), (1005, "buffer", "1:1")}


def test_dedup_and_merge(scenario):
    v, s = scenario
    clean = V.dedup_visits(v, "rid", "visit", "code", ["ventricles", "hippocampus"], ["row_id"], "status", "strength")
    assert {r.row_id for r in clean.collect()} == {1, 3, 6, 7, 8}
    merged = M.merge_pair(clean, s, "rid", "visit", "code", ["ventricles", "hippocampus"], status="status", strength="strength").collect()
    assert len(merged) == 8 and {r.rid for r in merged} == {1001, 1002, 1003, 1004, 1005, 3001, 3002}
    by = {}
    for r in merged:
        by.setdefault(r.rid, []).append(r)
    assert by[1001][0].ventricles == 1.0 and by[1001][0].mmse == 30.0
    assert sorted((r.visit, r.ventricles, r.mmse) for r in by[1005]) == [(day(180), 5.0, None), (day(200), None, 26.0)]
    assert by[1004][0].visit == day(60) and by[1004][0].mmse == 27.0


def test_many_rows_to_add_fail(scenario):
    v, s = scenario
    with pytest.raises(Exception, match="several rows to add"):
        M.merge_pair(s, v.drop("status"), "rid", "visit", "code", ["mmse"]).count()


def test_greedy_properties(spark):
    rng = random.Random(3)
    a = [(i, rng.randrange(20), day(rng.randrange(900))) for i in range(300)]
    b = [(i, rng.randrange(20), day(rng.randrange(900))) for i in range(300)]
    left, right = (spark.createDataFrame(x, "row_id long, s long, d date") for x in (a, b))
    got = M.match_visits(left, right, "s", "d").collect()
    for side in ("ids1", "ids2"):
        used = [i for r in got for i in r[side]]
        assert len(used) == len(set(used))
    assert all(abs((r.date1 - r.date2).days) <= 80 for r in got) and all((r.date1 == r.date2) == (r.kind == "exact") for r in got)
    want = set()
    for subject in range(20):
        d1, d2 = ({d for _, s, d in x if s == subject} for x in (a, b))
        want |= {(subject, d, d) for d in d1 & d2}
        pairs = sorted((abs((x - y).days), x, y) for x in d1 - d2 for y in d2 - d1 if abs((x - y).days) <= 80)
        u1, u2 = set(), set()
        for _, x, y in pairs:
            if x not in u1 and y not in u2:
                u1.add(x)
                u2.add(y)
                want.add((subject, x, y))
    assert {(r.subject, r.date1, r.date2) for r in got} == want
    spread = M.match_visits(left.repartition(7), right.repartition(3), "s", "d").collect()
    assert {(r.subject, r.date1, r.date2) for r in spread} == want


def test_as_of_prefers_the_earlier_and_the_last(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "s long, t double")
    right = spark.createDataFrame([(1, 8.0, 1.0, 1), (1, 12.0, 2.0, 2), (1, 20.0, 3.0, 3), (1, 20.0, 4.0, 4)], "s long, t double, v double, o int")
    got = {(r.s, r.t): r.v for r in M.as_of_nearest(left, right, "s", "t", "v", order=["o"]).collect()}
    want = pd.merge_asof(
        left.toPandas().sort_values("t"), right.toPandas().sort_values("t"), on="t", by="s", direction="nearest"
    ).set_index(["s", "t"])["v"]
    assert got[1, 10.0] == want[1, 10.0] == 1.0 and got[1, 20.0] == want[1, 20.0] == 4.0 and got[2, 5.0] is None


def test_one_row_per_visit_labels(spark):
    rows = [
        (1, 1, day(0), "m06", 5.0, 5.0), (2, 1, day(0), "bl", 5.0, 5.0), (3, 2, day(0), "x", 1.0, None), (4, 2, day(0), "x", 1.0, 2.0), (5, 2, day(0), "x", 3.0, None),
        (6, 3, day(0), "x", 1.0, 2.0), (7, 3, day(0), "bl", 3.0, 4.0), (8, 4, day(0), "x", 1.0, 2.0), (9, 4, day(0), "y", 3.0, 4.0), (10, 5, day(0), "y", 3.0, 4.0),
    ]
    df = spark.createDataFrame(rows, "row_id long, s long, d date, code string, a double, b double")
    got = {r.s: (r.row_id, r.strategy) for r in V.one_row_per_visit(df, "s", "d", "code", ["a", "b"], ["row_id"]).collect()}
    assert got == {
        1: (1, "Equal values"), 2: (4, "Min null values"), 3: (7, "VISITCODE priority"), 4: (8, "first row, same VISITCODE"), 5: (10, None),
    }
