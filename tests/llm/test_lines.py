"""Line dedup against a plain loop."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from visitframe.llm import line_dedup
from visitframe.llm.common import hot_join


def brute(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    seen, gone = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines = [] if text is None else text.split("\n")
        for i in range(len(lines) - 2):
            win = tuple(lines[i : i + 3])
            if "".join(win).strip(" "):
                if win in seen:
                    gone.setdefault(doc_id, set()).update((i, i + 1, i + 2))
                seen.add(win)
    return {d: t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_against_a_loop(spark):
    passage = "\n".join(f"a line of the shared passage number {k}" for k in range(6))
    rows = [(k, f"head {k}\n{passage}\ntail {k}") for k in range(50)]
    rows += [(100, f"{passage}\n{passage}"), (101, None), (102, ""), (103, "a\nb"), (104, "\n\n\n\n"), (105, "x\nx\nx\nx\nx"), (106, "\n".join(map(str, range(50_000))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.remove_repeated_lines(docs)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute(rows)
    assert got.where("doc_id = 0 and n_removed > 0 or doc_id = 1 and n_removed != 6").isEmpty()
    n = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got.collect()}
    assert n[101] == (0, 0) and n[102] == (1, 0) and n[105] == (5, 4)


def test_defined_cases(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [(None, text), (1, text), (1, text), (2, text + "\nfive")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).withColumn("n_lines", F.lit("old"))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.remove_repeated_lines(docs).collect())
    assert got == [(0, text), (1, ""), (1, ""), (2, "five")]
    assert line_dedup.op7_line_dedup(docs.limit(0)).count() == 0


def test_long_documents_are_rebuilt_in_linear_time(spark):
    n = 200_000
    rows = [(1, "a\nb\nc"), (2, "\n".join([f"line {k}" for k in range(n)] + ["a", "b", "c"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.monotonic()
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert time.monotonic() - start < 30  # 56 s at a tenth of the lines where the text is split for every kept line
    assert got[2]["n_removed"] == 3 and got[2]["text"] == "\n".join(f"line {k}" for k in range(n))


def test_very_common_windows_are_dealt_over_all_tasks(spark):
    big = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"))
    counted = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("found", F.col("k") * 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = hot_join(big, counted, ["k"], ["at"])
        assert got.count() == 30_000 and got.where("found != k * 2").isEmpty()
        assert got.where("k = 7").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert got.where("k = 8").select(F.spark_partition_id().alias("p")).distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
