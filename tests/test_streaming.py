"""The streaming matcher against a plain loop, batch by batch."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.streaming import visits

SCHEMA = "s long, t timestamp, side string, id long, extra string"
START = datetime(2024, 1, 1)


def plain(batches, buffer_days: int):
    """Greedy over all waiting visits, none ever dropped."""
    waiting, out = [], []
    for batch in batches:
        for s, t, side, rid in sorted(batch, key=lambda r: (r[1], r[3])):
            near = [w for w in waiting if w[0] == s and w[2] != side and abs(w[1] - t) <= timedelta(days=buffer_days)]
            if not near:
                waiting.append((s, t, side, rid))
                continue
            hit = min(near, key=lambda w: (abs(w[1] - t), w[1], w[3]))
            waiting.remove(hit)
            a, b = (rid, hit[3]) if side == "a" else (hit[3], rid)
            out.append((s, a, b, abs(hit[1] - t).days))
    return out


def landed(spark, folder: str, batches) -> None:
    """One file per batch, in the order in which the stream takes them."""
    for k, rows in enumerate(batches):
        part = f"{folder}/made{k}"
        spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1).write.parquet(part)
        source = next(f"{part}/{f}" for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(source, f"{folder}/in/{k:03d}.parquet")
        os.utime(f"{folder}/in/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def matched(spark, folder: str, name: str, buffer_days: int = 80):
    stream = visits.landing(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    found = visits.match_stream(stream, "s", "t", "side", "id", buffer_days)
    q = found.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def waiting_rows(spark, folder: str):
    state = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "waiting").load()
    return state.select(F.expr("cast(substr(key.subject, 2) as long)").alias("s"), F.explode("user_map_value.row_id").alias("id")).collect()


@pytest.mark.parametrize("buffer_days", [80, 5])
def test_stream_against_a_loop(spark, tmp_path, buffer_days):
    rng = np.random.default_rng(buffer_days)
    batches, rid = [], 0
    for k in range(5):
        rows = []
        for s in rng.choice([1, 1, 1, 2, 3, None], 60):
            rid += 1
            # whole days, so that gaps tie; each batch is later than the last one's watermark
            rows.append((s, START + timedelta(days=int(40 * k + rng.integers(0, 40))), str(rng.choice(["a", "b"])), rid))
        batches.append(rows)
    landed(spark, str(tmp_path), batches)
    got = matched(spark, str(tmp_path), f"loop{buffer_days}", buffer_days)
    assert sorted(got, key=str) == sorted(plain(batches, buffer_days), key=str) and len(got) > 50


def test_late_rows_and_expiry(spark, tmp_path):
    day = lambda n: START + timedelta(days=n)
    batches = [
        [(1, day(0), "a", 1), (1, day(100), "a", 2), (2, day(3), "b", 3), (None, day(1), "a", 4)],
        [(1, day(400), "a", 5), (9, day(400), "b", 6)],
        [(1, day(401), "a", 7)],
        # far behind the watermark: late, although visits 1 to 4 once lay within reach
        [(1, day(10), "b", 8), (2, day(4), "a", 9), (None, day(1), "b", 10), (1, day(410), "b", 11)],
        [(9, day(470), "a", 12)],
    ]
    landed(spark, str(tmp_path), batches)
    assert sorted(matched(spark, str(tmp_path), "late")) == [(1, 7, 11, 9), (9, 12, 6, 70)]
    # of those that never matched, only the one within reach of the watermark still waits
    assert {(r["s"], r["id"]) for r in waiting_rows(spark, str(tmp_path))} == {(1, 5)}


def test_rows_that_match_nothing(spark, tmp_path):
    rows = [(1, None, "a", 1), (1, START, "c", 2), (1, START, None, 3), (1, START, "a", None), (1, START, "b", 5), (1, START, "b", 5)]
    landed(spark, str(tmp_path), [rows, [(1, START, "a", 6), (1, START + timedelta(hours=30), "a", 7)]])
    assert sorted(matched(spark, str(tmp_path), "nulls")) == [(1, 6, 5, 0), (1, 7, 5, 1)]


def test_batches_take_the_same_function(spark):
    rows = [(1, START, "a", 1, "x"), (1, START + timedelta(days=80), "b", 2, "x"), (1, START + timedelta(days=161), "a", 3, "x"), (None, START, "b", 4, "x")]
    got = visits.match_stream(spark.createDataFrame(rows, SCHEMA), "s", "t", "side", "id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 80)]
    assert visits.match_stream(spark.createDataFrame([], SCHEMA), "s", "t", "side", "id").count() == 0
