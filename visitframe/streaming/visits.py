"""Streaming counterparts for visits that arrive over time. The same functions take a batch or a
streaming DataFrame."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

DAY_MS = 86_400_000


def landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(df: DataFrame, subject: str, time: str, value: str, width: str, late: str = "2 days") -> DataFrame:
    """Visits and their total per subject and tumbling window; later data than `late` is dropped
    from streams."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    return source.groupBy(subject, F.window(time, width).alias("w")).agg(F.count("*").alias("visits"), F.sum(value).alias("total")).select(
        subject, F.col("w.start").alias("day"), "visits", "total"
    )


def visit_sessions(df: DataFrame, subject: str, time: str, gap: str, late: str = "2 days") -> DataFrame:
    """Visits of a subject that follow each other within a gap."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    return source.groupBy(subject, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("visits")).select(
        subject, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "visits"
    )


def dedup_visits(df: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """First arrival of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


class VisitMatcher(StatefulProcessor):
    """Waiting visits of one subject by side and span of time, a span as long as the tolerance: a
    visit can only match within its own and the two next to it, so that a batch reads and
    writes no others. A timer removes a span when no visit that isn't late can reach it."""

    def __init__(self, tolerance_ms: int) -> None:
        self.tolerance = tolerance_ms
        self.span = max(tolerance_ms, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long, side string", "ms array<long>, row_id array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        stored: dict[tuple[int, str], int] = {}
        spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
        changed: set[tuple[int, str]] = set()

        def visits_of(span: tuple[int, str]) -> list[tuple[int, int]]:
            if span not in spans:
                found = self.waiting.getValue(span)
                spans[span] = list(zip(*found, strict=True)) if found else []
                stored[span] = len(spans[span])
            return spans[span]

        out = []
        for ms, row_id, own in sorted(pd.concat(list(rows))[["ms", "row_id", "side"]].itertuples(index=False, name=None)):
            other, at = "b" if own == "a" else "a", ms // self.span
            near = [(abs(v[0] - ms), v, (s, other)) for s in (at - 1, at, at + 1) for v in nearest_of(visits_of((s, other)), ms)]
            gap, hit, span = min(near, default=(self.tolerance + 1, None, None))
            if gap <= self.tolerance:
                spans[span].remove(hit)
                changed.add(span)
                out.append((key[0], *((row_id, hit[1]) if own == "a" else (hit[1], row_id)), gap // DAY_MS))
            else:
                insort(visits_of((at, own)), (ms, row_id))
                changed.add((at, own))
        for span in changed:
            if spans[span]:
                self.waiting.updateValue(span, tuple(map(list, zip(*spans[span], strict=True))))
                if not stored[span]:
                    self.handle.registerTimer((span[0] + 2) * self.span)
            elif stored[span]:
                self.waiting.removeKey(span)
        yield pd.DataFrame(out, columns=["subject", "id1", "id2", "gap"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        span = expiredTimerInfo.getExpiryTimeInMs() // self.span - 2
        for side in ("a", "b"):
            if self.waiting.containsKey((span, side)):
                self.waiting.removeKey((span, side))
        return iter([])


def nearest_of(waiting: list[tuple[int, int]], ms: int) -> list[tuple[int, int]]:
    """Of ascending (ms, row id) the nearest before ms and the nearest from ms on; of equal times the smallest id."""
    at = bisect_left(waiting, (ms,))
    before = [waiting[bisect_left(waiting, (waiting[at - 1][0],))]] if at else []
    return before + waiting[at : at + 1]


def match_stream(df: DataFrame, subject: str, time: str, side: str, row_id: str, buffer_days: int = 80, late: str = "1 day") -> DataFrame:
    """(subject, id1, id2, gap): visits of two tables in one stream (side a or b), matched one to one to
    the nearest waiting visit within the tolerance as they arrive, those of a batch by time and id. Of equally
    near ones the earlier is taken, then the smaller id.

    A visit waits until the watermark has passed its tolerance, so state is bounded by the tolerance; later
    data than `late` is dropped. Null subjects are one subject; rows without a time, an id or one of the two
    sides match nothing; repeated rows are visits of their own; other columns don't come through. State
    is kept in variables, for which a session needs the RocksDB state store (build_session sets it)."""
    # a null key would lose its state between batches
    source = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(subject).cast("string")), F.lit("")).alias("subject"), F.col(time).cast("timestamp").alias("t"), F.col(side).alias("side"), F.col(row_id).cast("long").alias("row_id")
    ).where("t is not null and row_id is not null and side in ('a', 'b')")
    source = source.withWatermark("t", late).withColumn("ms", F.unix_millis("t"))
    kind = dict(df.dtypes)[subject]
    found = source.groupBy("subject").transformWithStateInPandas(
        VisitMatcher(buffer_days * DAY_MS), "subject string, id1 long, id2 long, gap long", "append", "EventTime"
    )
    return found.withColumn("subject", F.when(F.col("subject") != "", F.substr("subject", F.lit(2)).cast(kind)))
