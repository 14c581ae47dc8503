"""Round trips, properties and small fixed cases."""

from __future__ import annotations

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.functions import scalars as X
from tests import series_plain
from visitframe.operators import cleaning, encoding, privacy, profiling, splitting, stats, timeseries
from visitframe.sources import catalog, files
from visitframe.sources.catalog import Catalog


def test_catalogue_round_trip(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "id long, x double")
    c.upload(df, "scales", metadata={"level": "raw", "file_code": "S"})
    c.upload(df.where("id = 1"), "scalessynthetic", metadata={"level": "raw", "file_code": "Ssynthetic"}, file_format="csv")
    assert c.search({"custom.level": ["raw", "clean"]}).count() == 2
    real, synthetic = c.load_pair("S", "raw")
    assert [r.x for r in real.orderBy("id").collect()] == [2.0, None] and synthetic.count() == 1
    c.update_metadata("scales", {"level": "clean"})
    assert c.search({"custom.level": "clean"}).first()["object_name"] == "scales"
    c.upload(df.limit(0), "scales", metadata={"level": "clean"})
    assert c.load_first({"custom.level": "clean"}).count() == 0
    c.delete("scales")
    assert c.search({"object_name": "scales"}).count() == 0
    with pytest.raises(LookupError):
        c.load_first({"custom.level": "none"})


def test_names():
    assert catalog.versioned_name("table_12.csv", "_clean") == "table_clean.csv"
    assert catalog.combination_name({"b": "7.0", "a": "x/y", "c": None}) == "x-y_7-0"
    assert catalog.combinations({"b": [1, 2], "a": []}) == [{"a": None, "b": 1}, {"a": None, "b": 2}]
    assert catalog.dataset_type("my_volumes.csv", ["SCALE", "VOLUMES"]) == "VOLUMES"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n1;2,5\n2;x\n")
    df = files.decimal_comma(files.read_csv(spark, str(tmp_path / "a.csv"), sep=";"), ["v"])
    assert [r.v for r in df.orderBy("id").collect()] == [2.5, None]
    (tmp_path / "n.txt").write_text("one\ntwo")
    assert files.read_any(spark, str(tmp_path / "n.txt")).first()[0] == "one\ntwo"
    (tmp_path / "o.json").write_text('{"a": 1}')
    assert files.read_any(spark, str(tmp_path / "o.json")).first()["a"] == 1
    (tmp_path / "x.bin").write_bytes(b"\0\1")
    assert bytes(files.read_any(spark, str(tmp_path / "x.bin")).first()["content"]) == b"\0\1"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.csv", "h\nä".encode("latin-1"))
        z.writestr("in/b.dat", b"raw")
    assert files.zip_members(spark, str(tmp_path / "z.zip")).count() == 2
    assert [r.line for r in files.extract_zip(spark, str(tmp_path / "z.zip")).orderBy("line_no").collect()] == ["h", "ä"]


def test_scales_round_trip(spark):
    df = spark.createDataFrame([(float(v), float(v)) for v in range(31)] + [(None, None)], "up double, down double")
    scales = {"up": (0, 30, "increasing"), "down": (0, 30, "inverse")}
    back = encoding.denormalize(encoding.normalize_fixed(df, scales), scales)
    assert sorted((r.up, r.down) for r in back.dropna().collect()) == [(v, v) for v in range(31)]


def test_dummies_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, c string")
    wide = encoding.dummies(df, "c", ["a", "b"])
    assert encoding.dummy_groups(wide) == {"c": ["c/a", "c/b"]}
    assert [r.c for r in encoding.undummies(wide, "c", "c").orderBy("id").collect()] == ["a", "b", None]


def test_noise_is_reproducible_and_clipped(spark):
    df = spark.range(500).select(F.col("id").alias("s"), F.lit(0.5).alias("v")).withColumn("s", F.col("s") % 20).withColumn("t", F.monotonically_increasing_id())
    a = privacy.correlated_noise(df, "s", "t", {"v": 0.3})
    b = privacy.correlated_noise(df.repartition(7), "s", "t", {"v": 0.3})
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert all(0 <= r.v <= 1 for r in a.collect())
    z = df.select("s", "t", privacy.hash_normal(["s", "t"], 1).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.2 and abs(z[1] - 1) < 0.2


def test_missing_rate(spark):
    real = spark.range(100).select(F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("v"))
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("v"))
    out = privacy.inject_missing(df, real, ["v"], "id")
    assert out.count() == 1000 and out.where("v is null").count() == 250


def test_splits(spark):
    df = spark.range(1000).select((F.col("id") % 90).alias("s"))
    parts = splitting.stratified_subjects(df, "s", 0.8)
    assert parts.where("part = 'train'").count() == sum(math.floor(0.8 * r["count"]) for r in parts.groupBy("n_visits").count().collect())
    assert splitting.allocate(10, {"a": 0.33, "b": 0.33, "c": 0.34}) == {"a": 3, "b": 3, "c": 4}


def test_unit_root_and_stationarity():
    rng = np.random.default_rng(0)
    noise = rng.standard_normal(400)
    walk = np.cumsum(noise)
    assert series_plain.adf(noise)[1] < 0.01 and series_plain.adf(walk)[1] > 0.05
    assert series_plain.kpss(noise)[1] >= 0.05 and series_plain.kpss(walk)[1] <= 0.05
    ar = np.zeros(2000)
    for i in range(2, 2000):
        ar[i] = 0.5 * ar[i - 1] + 0.3 * ar[i - 2] + rng.standard_normal()
    assert series_plain.orders(ar)[0] == 2
    assert abs(series_plain.pacf(ar, 3)[2] - 0.3) < 0.1 and abs(series_plain.pacf(ar, 3)[3]) < 0.1


def test_chi_square_tail():
    assert abs(stats.chi_square_p(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(stats.chi_square_p(18.307038053275146, 10) - 0.05) < 1e-9
    assert stats.chi_square_p(0, 3) == 1 and stats.chi_square_p(math.inf, 3) == 0


def test_ks_p_value(spark):
    df = spark.createDataFrame([(0.1, 1000.0, 1000.0), (0.0, 10.0, 10.0)], "d double, n double, m double")
    p = [r.p for r in df.select(stats.ks_p_value(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    assert p[0] < 0.001 and p[1] == 1.0


def test_whole_months_and_ages(spark):
    df = spark.createDataFrame([("2000-01-31", "2000-02-29"), ("2000-01-31", "2000-03-30"), ("2000-02-29", "2001-02-28")], "a string, b string")
    a, b = F.col("a").cast("date"), F.col("b").cast("date")
    assert [r.m for r in df.select(X.whole_months(a, b).alias("m")).collect()] == [1, 1, 12]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "Unknown"), (None, 2.0, "x")], "s long, v double, c string")
    assert cleaning.replace_unknown(df).where("c is null").count() == 1
    empty = df.limit(0)
    assert profiling.null_profile(empty).count() == 3
    assert cleaning.several_visits(empty, "s").count() == 0
    assert timeseries.kpss_per_subject(empty, "s", "c", "v").count() == 0


def test_streaming_counts_and_matches(spark, tmp_path):
    from visitframe.streaming import visits

    events = [(1, "2024-01-01 10:00:00", "a", 1), (1, "2024-01-20 10:00:00", "b", 2), (2, "2024-01-01 00:00:00", "a", 3), (2, "2024-06-01 00:00:00", "b", 4)]
    df = spark.createDataFrame(events, "s long, t string, side string, id long").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = visits.landing(spark, str(tmp_path / "in"), df.schema)
    q = visits.match_stream(stream, "s", "t", "side", "id").writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("matched").collect()] == [(1, 1, 2, 19)]
    w = visits.windowed_counts(stream.withColumn("v", F.lit(1.0)), "s", "t", "v", "1 day")
    q = w.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.subject if "subject" in r else r.s, r.visits) for r in spark.table("counted").collect()) == [(1, 1), (1, 1), (2, 1), (2, 1)]
