"""What showed up only on tables with other keys, ties or sizes than the given ones."""

from __future__ import annotations

import datetime as dt
import os

from tests.conftest import SMALL
from tests.oracle import TABLES, compare
from visitframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def folder(spark, path, **tables) -> str:
    """The smallest tables with some of them replaced by rows."""
    for name in TABLES:
        target = f"{path}/{name}.parquet"
        if name in tables:
            schema = spark.read.parquet(f"{SMALL}/{name}.parquet").schema
            spark.createDataFrame(tables[name], schema).write.parquet(target)
        else:
            os.symlink(f"{SMALL}/{name}.parquet", target)
    return str(path)


def test_an_id_on_two_rows_of_a_visit_is_one(spark, tmp_path):
    at = dt.datetime(1995, 1, 1)
    orders = [(1, 5, "O", 10.0, at, "1-URGENT"), (2, 6, "O", 20.0, at, "5-LOW")]
    item = (1, 7, 8, 3, 4.0, 100.0, 0.01, 0.02, "N", "O", at)
    sf = folder(spark, tmp_path, orders=orders, lineitem=[item, (*item[:4], 9.0, *item[5:])])
    compare(spark, QUERIES["paired_visit_rows"], SQL["paired_visit_rows"], sf)
    assert {(r.row_id_1, r.row_id_2) for r in QUERIES["paired_visit_rows"](spark, sf).collect()} == {(1, 11), (2, None)}


def test_distances_are_ordered_by_squares_where_roots_are_equal(spark):
    """1 + 2 ** -52 and 1 have the same root in doubles, and the nearer row has the larger id."""
    from visitframe.operators import matching

    base = spark.createDataFrame([(1, 1.0, 1.5e-8), (2, 1.0, 0.0)], "id long, a double, b double")
    asked = spark.createDataFrame([(9, 0.0, 0.0)], "id long, a double, b double")
    assert matching.blocked_nearest(asked, base, "id", ["a", "b"], 1).first()["base_id"] == 1
    assert matching.blocked_nearest(asked, base, "id", ["a", "b"], 1, by_square=True).first()["base_id"] == 2


def test_copies_of_queries_leave_in_pieces():
    import numpy as np
    import pandas as pd

    from visitframe.operators import matching

    asks = pd.DataFrame({"id": range(100), "x": [np.zeros(2)] * 100})
    rows, cells = np.repeat(np.arange(100), 256), np.tile(np.arange(256), 100)
    parts = list(matching.sent_to_cells(asks, rows, np.arange(100.0), cells))
    assert max(map(len, parts)) <= matching.SENT_AT_ONCE < len(rows)
    whole = pd.concat(parts)
    assert whole["id"].tolist() == rows.tolist() == whole["reach"].tolist() and whole["cell"].tolist() == cells.tolist()


def test_draws_of_the_bootstrap_are_those_of_the_hash(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from visitframe.operators import stats

    df = spark.range(300).repartition(3).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("h", F.xxhash64("id", "round", F.lit(42)))
    rows = df.select(F.xxhash64("id").alias("first"), "round", "h").collect()
    first, number, want = (np.array([r[c] for r in rows], np.int64) for c in ("first", "round", "h"))
    got = stats._hash_next(stats._hash_next(first.view(np.uint64), number), np.array([42]))
    assert (got.view(np.int64) == want).all()


def test_percentiles_between_counted_values(spark):
    import numpy as np

    from visitframe.operators import profiling

    rng = np.random.default_rng(2)
    v = rng.integers(0, 60, 500).astype(float)
    df = spark.createDataFrame([(float(x), None) for x in v] + [(None, None)], "v double, w double").repartition(4)
    plan = profiling.percentiles(df, ["v", "w"], (0.0, 0.013, 0.5, 1.0))
    assert "percentile(" not in plan._jdf.queryExecution().toString()  # no aggregate that holds all values
    got = {r["variable"]: r for r in plan.collect()}
    assert np.allclose([got["v"][c] for c in ("p00", "p01", "p50", "p100")], np.quantile(v, [0, 0.013, 0.5, 1]))
    assert got["w"]["p50"] is None


def test_a_merge_computes_the_rows_to_add_once(spark):
    """Matching, attaching and what is left over read one shuffle of them."""
    from pyspark.sql import functions as F

    from visitframe.operators import matching, visits

    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    at = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 37 % 900).cast("int"))
    base = spark.range(300).select((F.col("id") % 20).alias("s"), at.alias("d"), F.col("id").alias("row_id"), F.col("id").alias("m"))
    add = spark.range(400).select((F.col("id") % 20).alias("s"), F.date_add(at, 3).alias("d"), F.udf(count, "long")("id").alias("row_id"), F.col("id").alias("n"))
    base, add = visits.best_row(base, ["s", "d"], ["m"], ["row_id"]), visits.best_row(add, ["s", "d"], ["n"], ["row_id"])
    merged = matching.merge_pair(base, add, "s", "d", None, ["m"]).collect()
    assert seen.value == 400
    assert sum(r["m"] is not None for r in merged) == base.count() and sum(r["n"] is not None for r in merged) == add.count()


def test_an_id_on_several_dates_goes_with_all_of_them(spark):
    from visitframe.operators import matching

    day = dt.date(2020, 1, 1)
    base = spark.createDataFrame([(1, day, 1, 5.0), (1, day + dt.timedelta(300), 2, 6.0), (2, None, 3, 7.0)], "s long, d date, row_id long, m double")
    add = spark.createDataFrame([(1, day, 9, 0.5), (1, day + dt.timedelta(600), 9, 0.25), (2, day, 8, 0.125)], "s long, d date, row_id long, n double")
    rows = matching.merge_pair(base, add, "s", "d", None, ["m"]).collect()
    got = sorted((r["s"], r["row_id"], str(r["m"]), str(r["n"])) for r in rows)
    assert got == [(1, 1, "5.0", "0.25"), (1, 1, "5.0", "0.5"), (1, 2, "6.0", "None"), (2, 3, "7.0", "None"), (2, 8, "None", "0.125")]


def test_buffered_pairs_move_the_rows_of_a_side_once(spark):
    """Over all days, on both sides of a stretch's ends, with exact dates there, negative days and NULLs; and by one shuffle, where no side is broadcast."""
    import random

    from visitframe.operators import matching

    rng = random.Random(7)

    def rows():
        day = lambda: None if rng.random() < 0.05 else dt.date(1969, 6, 1) + dt.timedelta(rng.randrange(60))
        return [(None if rng.random() < 0.05 else rng.randrange(8), day(), k, rng.choice([None, "x", "y"])) for k in range(200)]

    a, b = rows(), rows()
    left, right = spark.createDataFrame(a, "s long, d1 date, i1 long, c1 string"), spark.createDataFrame(b, "s long, d2 date, i2 long, c2 string")
    keys = lambda side: {(s, d) for s, d, *_ in side if s is not None and d is not None}
    exact = keys(a) & keys(b)
    want = {
        (x[2], y[2], x[1], y[1], x[3], y[3]) for x in a for y in b
        if x[0] is not None and x[0] == y[0] and x[1] and y[1] and abs((x[1] - y[1]).days) <= 2 and (x[0], x[1]) not in exact and (y[0], y[1]) not in exact
    }
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for equal in ((), [("c1", "c2")]):
            found = matching.buffered_pairs(left, right, "s", "d1", "d2", 2, equal).select("i1", "i2", "d1", "d2", "c1", "c2")
            got = [tuple(r) for r in found.collect()]
            assert len(got) == len(set(got)) and set(got) == {w for w in want if not equal or w[4] == w[5]}
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count(" Exchange hashpartitioning") - plan.count("ReusedExchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_forest_reads_each_text_once(spark, monkeypatch):
    """Both fits and tests and the split of subjects go by rows computed once."""
    from pyspark.sql import functions as F

    from visitframe.plans import validation_queries

    seen, load = spark.sparkContext.accumulator(0), validation_queries.t

    def count(x):
        seen.add(1)
        return x

    def counted(session, sf, name):
        df = load(session, sf, name)
        return df.withColumn("text", F.udf(count, "string")("text")) if name == "documents" else df

    monkeypatch.setattr(validation_queries, "t", counted)
    rows = validation_queries.tstr_forest(spark, SMALL).collect()
    assert len(rows) == 6 and 0 < seen.value <= load(spark, SMALL, "documents").count()


def test_sizes_of_texts_are_those_of_a_plain_loop(spark, tmp_path, monkeypatch):
    from visitframe.operators import validation
    from visitframe.plans import validation_queries

    texts = ["", " ", "  two  spaces ", "A", "AbC dE\nF\tG", "$5 & |x| #!*%", "é𝔄Z $", "ABC" * 50, "no marks", " A b", None]
    documents = [(k, text, "en", "web", len(text or "")) for k, text in enumerate(texts)]
    sf = folder(spark, tmp_path, documents=documents, labels=[(k, k % 2, 0) for k in range(len(texts))])
    got = []

    def keep(real, synthetic, *rest):
        got.extend(real.unionByName(synthetic).collect())
        return real.limit(0)

    monkeypatch.setattr(validation, "utility", keep)
    validation_queries.tstr_forest(spark, sf)
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        want = (None,) * 4 if text is None else (len(text), len(text) / len(text.split(" ")), sum("A" <= c <= "Z" for c in text), sum(c in "%$#*&!|" for c in text))
        assert (r["size"], r["mean_word"], r["capitals"], r["symbols"]) == want and r["quality"] == str(r["doc_id"] % 2) and r["subject"] == r["doc_id"]


def test_links_move_base_rows_once_by_subject(spark):
    """As they are, without lists of their ids; of the rows to add only a subject's arrays move. Subjects on one side alone, or NULL, have no links."""
    import re

    from visitframe.operators import matching, visits

    d = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    base = spark.createDataFrame([(1, d(0), 1, 5.0), (1, d(0), 2, None), (2, d(0), 3, 5.0), (None, d(9), 4, 5.0), (5, None, 5, 5.0), (6, d(4), 6, 5.0)], "s long, d date, row_id long, m double")
    add = spark.createDataFrame([(1, d(7), 11, 0.5), (3, d(0), 12, 0.5), (None, d(9), 13, 0.5), (5, d(0), 14, 0.5), (6, d(4), 15, 0.5)], "s long, d date, row_id long, n double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = matching._row_links(base, visits.best_row(add, ["s", "d"], ["n"], ["row_id"]), "s", "d", None, ["m"], "row_id", 80, None, None)
        got = {(r["subject"], r["id1"], r["id2"], r["kind"], r["gap"]) for r in links.collect()}
        plan = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {(1, 1, 11, "buffer", -7), (6, 6, 15, "exact", 0)}
    assert "Union" not in plan and len(re.findall(r"Exchange hashpartitioning\(subject#\d+L, \d+\), REPARTITION_BY_COL", plan)) == 1
    assert plan.count("Exchange hashpartitioning") == 3
