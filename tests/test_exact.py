"""Exact results against brute force on small tables."""

from __future__ import annotations

import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.operators import cleaning, conflicts, course, encoding, matching, ordering, privacy, profiling, stats, validation, visits
from visitframe.sources import catalog


def test_pseudo_median_by_counting(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=151), rng.integers(0, 9, 300).astype(float), np.array([2.5] * 7), np.array([1.0, 4.0])):
        i, j = np.triu_indices(len(values))
        want = np.median((values[i] + values[j]) / 2)
        df = spark.createDataFrame([(float(v), 0.0) for v in values], "x double, y double")
        assert abs(stats.pseudo_median(df, "x", "y").first()[0] - want) < 1e-9
    assert stats.pseudo_median(df.limit(0), "x", "y").first()[0] is None


def test_p_values_against_known_ones():
    # tables of Student's t: two-sided 5 % and 1 % points
    for degrees, t5, t1 in ((1, 12.7062, 63.6567), (5, 2.57058, 4.03214), (30, 2.04227, 2.75000), (1000, 1.96234, 2.58075)):
        assert abs(stats.t_p_value(t5, degrees) - 0.05) < 1e-5 and abs(stats.t_p_value(t1, degrees) - 0.01) < 1e-5
    assert stats.t_p_value(0.0, 7) == 1.0
    # the published example of eleven weights
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.79) < 0.005 and abs(p - 0.0067) < 0.0005
    normal = statistics.NormalDist(3, 2)
    assert stats.shapiro_wilk([normal.inv_cdf((k + 0.5) / 400) for k in range(400)])[1] > 0.9
    assert stats.shapiro_wilk([math.exp(normal.inv_cdf((k + 0.5) / 400)) for k in range(400)])[1] < 1e-6


def test_methods_that_agree_and_that_dont(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(50, 10, 6000)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, x + rng.normal(0, 0.5, 6000), x * 1.3 + 4, strict=True)]
    df = spark.createDataFrame(rows, "x double, near double, far double")
    near, far = stats.compare_methods(df, "x", "near").first(), stats.compare_methods(df, "x", "far").first()
    assert near["ccc"] > 0.99 and near["normality_test"] == "kolmogorov_smirnov" and near["normality_p"] > 0.01
    assert not far["interchangeable"] and far["t_p"] < 1e-9 and far["w_p"] < 1e-9
    d = np.array([r[0] - r[1] for r in rows])
    order = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(order[d > 0].sum(), order[d < 0].sum())
    z = (w - 6000 * 6001 / 4) / math.sqrt(6000 * 6001 * 12001 / 24)
    assert near["w"] == w and abs(near["w_p"] - round(math.erfc(abs(z) / math.sqrt(2)), 4)) < 1e-3


def test_nearest_rows_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 4))[rng.integers(0, 20, 900)] * 4 + rng.normal(size=(900, 4))
    x[100:130] = x[7]  # many equal rows
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, a double, b double, c double, d double")
    span = np.ptp(x, axis=0)
    for metric, full in (("euclidean", np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))), ("gower", (np.abs(x[:, None] - x[None]) / span).mean(axis=2))):
        ranges = {c: float(s) for c, s in zip("abcd", span, strict=True)}
        got: dict[int, list] = {}
        found = matching.blocked_nearest(df.where("id % 5 = 0"), df, "id", list("abcd"), 3, metric, ranges=ranges, same_id=False, block=64)
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["base_id"], round(r["distance"], 9)))
        for q in range(0, 900, 5):
            d = full[q].copy()
            d[q] = np.inf
            assert got[q] == [(int(k), round(float(d[k]), 9)) for k in np.lexsort((np.arange(900), d))[:3]], (metric, q)
    assert matching.blocked_nearest(df, df.limit(0), "id", ["a"], 1).count() == 0


def test_categories_and_equal_rows_by_gower(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.normal(size=400)]).astype(float)
    x[50:250] = x[3]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, a double, b double, c double")
    span = float(np.ptp(x[:, 2]))
    full = ((x[:, None, :2] != x[None, :, :2]).sum(axis=2) + np.abs(x[:, None, 2] - x[None, :, 2]) / span) / 3
    found = matching.blocked_nearest(df, df, "id", list("abc"), 4, "gower", ["a", "b"], {"c": span}, same_id=True, block=50)
    got = {(r["query_id"], r["rank"]): (r["base_id"], round(r["distance"], 9)) for r in found.collect()}
    for q in range(400):
        want = np.lexsort((np.arange(400), np.round(full[q], 12)))[:4]
        assert [got[q, n + 1] for n in range(4)] == [(int(k), round(float(full[q, k]), 9)) for k in want]


@pytest.mark.parametrize("metric", ["euclidean", "gower"])
def test_few_rows_are_compared_in_full_in_64_dimensions(spark, metric):
    """Of the base rows of the given vectors, a query fetches less than one in a hundred."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null and size(embedding) = 64")
    v = v.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    names = v.columns[1:]
    asked = v.where("vec_id % 10 = 0")
    pairs, q, b = matching.nearest_candidates(asked, v, "vec_id", names, 3, metric, same_id=False)
    share = pairs.count() / (q.count() * b.count())
    assert 0 < share < 0.01
    x = np.array(v.orderBy("vec_id").select(*names).collect())
    ids = np.array([r[0] for r in v.select("vec_id").orderBy("vec_id").collect()])
    got = {(r["query_id"], r["rank"]): r["distance"] for r in matching.blocked_nearest(asked, v, "vec_id", names, 3, metric, same_id=False).collect()}
    for at in np.flatnonzero(ids % 10 == 0)[::7]:
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1)) if metric == "euclidean" else np.abs(x - x[at]).mean(axis=1)
        d[at] = np.inf
        assert np.allclose([got[int(ids[at]), n] for n in (1, 2, 3)], np.sort(d)[:3])


def test_streamed_visits_against_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(None if s == 0 else s, k, *(None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 50, 2))) for s in range(12) for k in range(int(rng.integers(1, 40)))]
    df = spark.createDataFrame(rows, "subject int, day int, a double, b double")
    got = {(r["subject"], r["day"]): r["m"] for r in visits.merge_two_sources(df, "subject", "day", "a", "b", "m", 5, 40).collect()}
    previous: dict = {}
    for s, day, a, b in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        fine = [v for v in (a, b) if v is not None and 5 <= v <= 40]
        before = previous.get(s)
        pool = [v for v in fine if before is None or v >= before] or fine
        want = None if not pool else pool[0] if before is None else min(pool, key=lambda v: abs(v - before))
        assert got[(s, day)] == want
        previous[s] = want if want is not None else before
    times = spark.createDataFrame([(1, 2.0, k) for k in range(4)] + [(2, 1.0, 0), (2, 3.0, 1), (None, 5.0, 2), (None, 5.0, 3)], "subject int, t double, k int")
    moved = {(r["subject"], r["k"]): r["t"] for r in visits.strictly_increasing(times, "subject", "t").collect()}
    up = lambda v, n: v if not n else np.nextafter(up(v, n - 1), np.inf)
    assert moved == {(1, k): up(2.0, k) for k in range(4)} | {(2, 0): 1.0, (2, 1): 3.0, (None, 2): 5.0, (None, 3): up(5.0, 1)}


def test_correlated_noise_follows_its_recursion(spark):
    df = spark.range(700).select((F.col("id") % 2).alias("s"), F.col("id").alias("t"), F.lit(0.5).alias("v"))
    out = privacy.correlated_noise(df, "s", "t", {"v": 0.1}, rho=0.9, clip=False)
    drawn = {(r["s"], r["t"]): r["e"] for r in df.withColumn("e", privacy.hash_normal(["s", "t"], 42, "v")).collect()}
    got = {(r["s"], r["t"]): r["v"] - 0.5 for r in out.collect()}
    for s in (0, 1):
        x = None
        for t in range(s, 700, 2):
            e = drawn[(s, t)]
            x = 0.1 * e if x is None else 0.9 * x + 0.1 * math.sqrt(1 - 0.81) * e
            assert abs(got[(s, t)] - x) < 1e-12


def test_lookups_beyond_the_old_bounds(spark):
    cutoffs = spark.range(12_000).select(F.lit("ab").alias("marker"), F.format_string("m%d", "id").alias("method"), F.col("id").cast("double").alias("cutoff"))
    df = spark.range(12_000).select(F.format_string("M%d", "id").alias("how"), F.col("id").cast("double").alias("want"))
    assert cleaning.cutoff_lookup(df, cutoffs, "ab", "how", "cut").where("cut = want").count() == 12_000
    listing = spark.createDataFrame([("x_a_b",), ("x_a_b",), ("none",)], "text string")
    names = spark.createDataFrame([("b", 2), ("a", 1)], "part string, no int")
    found = catalog.first_match(listing, names, "text", "part", ["no"]).collect()
    assert [r["part"] for r in found] == ["a", "a"]
    with pytest.raises(ValueError, match="names"):
        catalog.first_match(listing, names, "text", "part", ["no"], most_names=1)


def test_every_combination_is_merged(spark):
    a = spark.createDataFrame([(1, "2020-01-01", 1, "x", 1.0), (1, "2020-06-01", 2, "y", 2.0), (2, "2020-01-01", 3, "x", None)], "s int, d string, row_id long, f string, m double")
    b = spark.createDataFrame([(1, "2020-01-03", 1, 7.0), (3, "2020-02-02", 2, 8.0)], "s int, d string, row_id long, n double")
    a, b = (t.withColumn("d", F.to_date("d")) for t in (a, b))
    out = matching.merge_combinations({"a": a, "b": b}, {"a": "f"}, "s", "d", code=None, measures=["m"], buffer_days=5)
    rows: dict[str, list] = {}
    for r in out.fillna(-1.0, ["m", "n"]).collect():
        rows.setdefault(r["combination"], []).append((r["s"], r["m"], r["n"]))
    assert {k: sorted(v) for k, v in rows.items()} == {"x": [(1, 1.0, 7.0), (2, -1.0, -1.0), (3, -1.0, 8.0)], "y": [(1, -1.0, 7.0), (1, 2.0, -1.0), (3, -1.0, 8.0)]}
    one = matching.merge_combinations({"a": a, "b": b}, {"a": "f"}, "s", "d", {"f": ["y", "absent"]}, code=None, measures=["m"])
    assert {r["combination"] for r in one.collect()} == {"y"}
    every = matching.merge_combinations({"a": a, "b": b}, {"a": "f"}, "s", "d", {"f": []}, code=None, measures=["m"], buffer_days=5)
    assert sorted((r["s"], r["m"]) for r in every.where("m is not null").collect()) == [(1, 1.0), (1, 2.0)]
    ids = [r["row_id"] for r in out.collect()]
    assert len(set(ids)) == len(ids)
    with pytest.raises(ValueError, match="whitelist"):
        matching.merge_combinations({"a": a, "b": b}, {"a": "f"}, "s", "d", code=None, measures=["m"], most=1)


def test_combinations_are_merged_as_one_by_one(spark):
    """Three tables, two filters: each combination equals the merge of its own rows, and the jobs don't grow with the combinations."""
    rng = np.random.default_rng(9)

    def visits(seed: int, filters: dict[str, list[str]]):
        own = np.random.default_rng(seed)
        rows = [(int(own.integers(1, 12)), int(own.integers(0, 900)), k, float(k), *[str(own.choice(v)) for v in filters.values()]) for k in range(90)]
        fields = "".join(f", {c} string" for c in filters)
        df = spark.createDataFrame(rows, f"s int, day int, row_id long, m{seed} double{fields}")
        return df.dropDuplicates(["s", "day"]).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day"))).drop("day").cache()

    tables = {"a": visits(1, {"f": ["x", "y", "z"]}), "b": visits(2, {"g": ["u", "v"]}), "c": visits(3, {})}
    settings = {"code": None, "measures": ["m1"], "buffer_days": 40}
    kept = [c for c in ("s", "d", "m1", "m2", "m3")]

    def jobs(whitelist) -> tuple[int, list]:
        group = f"combinations {rng.integers(1 << 30)}"
        spark.sparkContext.setJobGroup(group, group)
        out = matching.merge_combinations(tables, {"a": "f", "b": "g"}, "s", "d", whitelist, **settings).select("combination", *kept).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out

    few, _ = jobs({"f": ["x"], "g": ["u"]})
    many, found = jobs({"f": ["x", "y", "z"], "g": ["u", "v"]})
    assert many <= few + 4  # adaptive plans may start a job more or less
    assert len({r["combination"] for r in found}) == 6
    for f in "xyz":
        for g in "uv":
            one = matching.merge_all([tables["a"].where(F.col("f") == f), tables["b"].where(F.col("g") == g), tables["c"]], subject="s", date="d", **settings)
            want = sorted(map(str, (tuple(r) for r in one.select(*kept).collect())))
            assert sorted(str(tuple(r)[1:]) for r in found if r["combination"] == f"{f}_{g}") == want


def test_noise_classes_by_bounded_sets(spark):
    rng = np.random.default_rng(12)
    n = 500
    columns = {
        "ten": rng.integers(-5, 5, n), "eleven": rng.integers(-5, 6, n), "wide": rng.choice([0, 21], n), "span20": rng.choice([-7, 3, 13], n), "half": rng.choice([0.5, 1.0], n),
        "x/y": rng.integers(0, 2, n), "flag": rng.integers(0, 2, n), "real": rng.normal(size=n), "huge": rng.choice([1e300, 2.0], n), "known": rng.normal(size=n), "far": rng.choice([10**12, 10**12 + 4], n),
    }
    df = spark.createDataFrame([(k, k, *[float(v[k]) for v in columns.values()]) for k in range(n)], "s long, t long, " + ", ".join(f"`{c}` double" for c in columns))
    df = df.withColumn("none", F.lit(None).cast("double"))

    def plain(c: str) -> str:
        v = columns[c]
        if "/" in c and set(v) <= {0, 1}:
            return "dummy"
        few = len(set(v)) <= 10 and all(x == np.floor(x) for x in v) and max(v) - min(v) <= 20
        return "ordinal" if c == "known" or few else "continuous"

    found = privacy.noise_classes(df, "s", "t", ["known"])
    assert {r["variable"]: r["class"] for r in found.collect()} == {c: plain(c) for c in columns} | {"none": "continuous"}
    assert "Expand" not in found._jdf.queryExecution().toString()


def plain_tau(x: list[float], y: list[float]) -> tuple[float, int]:
    s = dx = dy = apart = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, dx, dy, apart = s + a * b, dx + (a != 0), dy + (b != 0), apart + (a * b < 0)
    return s / math.sqrt(dx * dy), apart


def test_kendall_tau_against_all_pairs(spark):
    rng = np.random.default_rng(21)
    cases = [(rng.integers(0, 40, 300), rng.integers(0, 30, 300)), (np.arange(200), rng.permutation(200)), (rng.normal(size=150), rng.choice([1.0, 2.0], 150, p=[0.9, 0.1]))]
    for x, y in cases:
        rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, math.nan)]
        found = stats.kendall_tau(spark.createDataFrame(rows, "x double, y double"), "x", "y")
        tau, _ = plain_tau(list(x), list(y))
        assert found["n"] == len(x) and math.isclose(found["tau"], tau, abs_tol=1e-12) and 0 <= found["p"] <= 1
    y = [2, 1, 4, 3, 5, 6]
    found = stats.kendall_tau(spark.createDataFrame(list(enumerate(y)), "x int, y int"), "x", "y")
    taus = [abs(plain_tau(list(range(6)), list(p))[0]) for p in itertools.permutations(y)]
    assert math.isclose(found["p"], np.mean([t >= abs(found["tau"]) - 1e-12 for t in taus]))
    assert math.isnan(stats.kendall_tau(spark.createDataFrame([(1, 1), (1, 2)], "x int, y int"), "x", "y")["tau"])
    assert stats.kendall_tau(spark.createDataFrame([], "x int, y int"), "x", "y")["n"] == 0


def test_sequences_compared(spark):
    a = ["x > y"] * 5 + ["y > x"] * 3 + ["x"] * 2 + [""] * 9 + ["z"]
    b = ["x > y"] * 4 + ["x"] * 3 + ["y > x"] * 2 + ["w"]
    one, other = (spark.createDataFrame(list(enumerate(t)), "subject int, sequence string") for t in (a, b))
    top = [tuple(r) for r in visits.top_sequences(one, 3).orderBy("rank").collect()]
    assert top == [(1, "x > y", 5, 0.25), (2, "y > x", 3, 0.15), (3, "x", 2, 0.1)]
    row = visits.compare_sequences(one, other, 3, 2).first()
    assert (row["overlap"], row["n_common"]) == (0.5, 3) and math.isclose(row["tau"], 1 / 3) and not row["passed"]
    same = visits.compare_sequences(one, one).first()
    assert same["passed"] and same["overlap"] == 0.8 and same["tau"] == 1.0


def test_modes_of_validation(spark):
    rng = np.random.default_rng(31)
    real = spark.createDataFrame([(k, k % 9, float(v), float(60 + k % 10), "a", float(v > 0)) for k, v in enumerate(rng.normal(size=400))], "row long, s long, x double, AGE double, c string, y double")
    rows = [(k, k % 9, float(v), float(40 + k % 60), "a", float(v > 0), 1) for k, v in enumerate(rng.normal(size=400))]
    synthetic = spark.createDataFrame(rows, "row long, s long, generated_x double, AGE double, generated_c string, y double, generation_id int")
    found = validation.validate(real, synthetic, "row", "s", ["x", "y", "z"], ["c"], "age_matching")
    tests = {(r["test"], r["variable"]): r for r in found.collect()}
    assert set(tests) == {("ks", "x"), ("ks", "y"), ("correlation", None)}
    r, s = validation.age_matched(real, synthetic, "row", "AGE", 5)
    assert {x[0] for x in s.select("AGE").distinct().collect()} == set(range(60, 70)) and r.count() == s.count() < 100
    plain = validation.validate(real, real, "row", "s", ["x", "y"], [], "age_matching", align=False).where("test = 'ks'").first()
    assert plain["value"] > 0.99
    used = validation.validate(real, synthetic, "row", "s", ["x"], [], "utility", target="y")
    assert {r["test"] for r in used.collect()} == {"utility"}
    own = validation.validate(real, synthetic, "row", "s", ["x"], [], "utility", target="y", utility_synthetic=real.limit(100))
    assert own.count() == used.count()
    for mode, more in (("none", {}), ("utility", {})):
        with pytest.raises(ValueError, match="mode"):
            validation.validate(real, synthetic, "row", "s", ["x"], [], mode, **more)


def test_dates_follow_their_links(spark):
    base = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-02-02"), (3, None)], "row_id long, d string")
    add = spark.createDataFrame([(10, "2020-01-05", 1), (11, "2020-05-05", 2), (12, "2020-06-06", 3)], "row_id long, d string, v int")
    links = spark.createDataFrame([(2, 10), (1, 10), (3, 12), (99, 11)], "id1 long, id2 long")
    got = {r["row_id"]: (r["d"], r["v"]) for r in matching.align_dates(base, add, links, "d").collect()}
    assert got == {10: ("2020-01-01", 1), 11: ("2020-05-05", 2), 12: (None, 3)}


def test_individual_parameters_are_found(spark):
    """Planted parameters: exactly without noise; with noise of 0.02 the mean error stays below 0.05 and 0.6 years."""
    rng = np.random.default_rng(17)
    features = {"a": {"g": 2.0, "v0": 0.02}, "b": {"g": 0.5, "v0": 0.04}}
    planted = {s: (float(rng.normal(0, 0.4)), float(rng.normal(70, 8))) for s in range(60)}

    def rows(noise: float):
        out = []
        for s, (xi, tau) in planted.items():
            for t in rng.uniform(55, 95, 400 if s == 0 else 12):
                y = [1 / (1 + p["g"] * math.exp(-p["v0"] * (1 + p["g"]) ** 2 / p["g"] * math.exp(xi) * (t - tau))) + noise * rng.normal() for p in features.values()]
                out.append((s, float(t), y[0], None if rng.random() < 0.1 else y[1]))
        return spark.createDataFrame([*out, (None, 60.0, 0.5, 0.5), (1, None, 0.5, 0.5), (99, 60.0, None, math.nan)], "s long, t double, a double, b double")

    exact = course.individual_parameters(rows(0.0), "s", "t", features, 70.0, 10.0, 5.0, 1e-4)
    got = {r["s"]: (r["xi"], r["tau"]) for r in exact.collect()}
    assert got.keys() == planted.keys()
    assert all(abs(got[s][0] - planted[s][0]) < 1e-3 and abs(got[s][1] - planted[s][1]) < 1e-2 for s in planted)
    found = course.individual_parameters(rows(0.02), "s", "t", features, 70.0, 10.0, 0.5, 0.02).collect()
    assert all(r["converged"] for r in found)
    assert np.mean([abs(r["xi"] - planted[r["s"]][0]) for r in found]) < 0.05 and np.mean([abs(r["tau"] - planted[r["s"]][1]) for r in found]) < 0.6


def test_population_curve_is_that_of_the_mean_subject(spark):
    features = {"a": {"g": 2.0, "v0": 0.02}, "b": {"g": 0.5, "v0": 0.04}}
    times = [50.0, 70.0, 90.0]
    rows = course.score(spark.createDataFrame([(t, 0.0, 70.0) for t in times], "t double, xi double, tau double"), "t", "xi", "tau", features).orderBy("t").collect()
    curve = course.population_curve(features, times, 70.0)
    assert all(math.isclose(r[f], curve[f][k]) for k, r in enumerate(rows) for f in features)


def test_fits_and_what_they_predict(spark):
    x = np.linspace(1, 50, 200)
    rng = np.random.default_rng(3)
    y = 7 + 3 * np.log(x) + rng.normal(size=200)
    df = spark.createDataFrame([*zip(map(float, x), map(float, y), strict=True), (-1.0, 2.0), (None, 1.0), (2.0, math.nan)], "x double, y double")
    fit = stats.log_fit(df, "x", "y")
    row = fit.first()
    slope, intercept = np.polyfit(np.log(x), y, 1)
    off = y - intercept - slope * np.log(x)
    assert np.allclose([row["n"], row["slope"], row["intercept"], row["mse"], row["r2"]], [200, slope, intercept, (off**2).mean(), 1 - (off**2).mean() / y.var()])
    far = spark.createDataFrame([(90061.5,), (2.0,)], "x double")
    got = stats.predict_polynomial(stats.predict_log(far, "x", fit, "l"), "x", [1.0, 2.0, 0.5], "p").collect()
    assert all(math.isclose(r["l"], intercept + slope * math.log(r["x"])) and math.isclose(r["p"], 1 + 2 * r["x"] + 0.5 * r["x"] ** 2) for r in got)
    parts = stats.duration_parts(far, "x").first()
    assert (parts["days"], parts["hours"], parts["minutes"], parts["seconds"]) == (1, 1, 1, 1.5)
    assert stats.log_fit(df.limit(0), "x", "y").first()["slope"] is None
