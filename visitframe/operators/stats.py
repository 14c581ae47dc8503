"""Statistics of two samples and of two methods, from aggregates."""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from visitframe.operators.ordering import global_index, running_sums
from visitframe.operators.profiling import correlations
from visitframe.session import materialize


def running_share(values: DataFrame) -> DataFrame:
    """(value, share) of a column `value`."""
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return running_sums(counts, "value", {"cum": "n"}).crossJoin(F.broadcast(total)).select("value", (F.col("cum") / F.col("__t")).alias("share"))


def ks_statistic(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_real, n_synthetic, statistic): the largest gap of the two empirical distribution
    functions. All columns at once: running counts go over (variable, value), and each variable's start
    from what lies before it."""
    sides = []
    for t, a in ((real, 1), (synthetic, 0)):
        long = t.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "v")
        sides.append(long.where("v is not null").select("variable", "v", F.lit(a).alias("a"), F.lit(1 - a).alias("b")))
    per = materialize(sides[0].unionByName(sides[1]).groupBy("variable", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    totals = per.groupBy("variable").agg(F.sum("a").alias("n_real"), F.sum("b").alias("n_synthetic"))
    before = Window.orderBy("variable").rowsBetween(Window.unboundedPreceding, -1)  # one row per column
    starts = totals.select(
        "variable", "n_real", "n_synthetic", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(s) for n, s in (("n_real", "sa"), ("n_synthetic", "sb"))]
    )
    run = running_sums(per, ["variable", "v"], {"ca": "a", "cb": "b"}).join(F.broadcast(starts), "variable")
    gap = F.abs(F.try_divide(F.col("ca") - F.col("sa"), F.col("n_real")) - F.try_divide(F.col("cb") - F.col("sb"), F.col("n_synthetic")))
    return run.groupBy("variable", "n_real", "n_synthetic").agg(F.max(gap).alias("statistic"))


def ks_p_value(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value (the Kolmogorov series)."""
    en = F.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def chi_square(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(variable, statistic, degrees): synthetic counts against real shares of the synthetic size."""
    a = real.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("r"))
    b = synthetic.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("s"))
    both = a.join(b, "k", "full_outer").fillna(0, ["r", "s"])
    totals = both.agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    expected = F.col("r") * F.col("ts") / F.col("tr")
    cell = F.when(expected == 0, F.lit(float("inf"))).otherwise((F.col("s") - expected) ** 2 / expected)
    cell = F.when((expected == 0) & (F.col("s") == 0), 0.0).otherwise(cell)
    return both.crossJoin(F.broadcast(totals)).agg(F.sum(cell).alias("statistic"), (F.count("*") - 1).alias("degrees")).select(
        F.lit(column).alias("variable"), "statistic", "degrees"
    )


def chi_square_p(statistic: float, degrees: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function by its
    series or continued fraction."""
    a, x = degrees / 2, statistic / 2
    if degrees <= 0 or x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def correlation_distance(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean absolute difference over the full matrices (zero diagonal included) and the
    correlation of the upper triangles."""
    a = correlations(real, columns).withColumnRenamed("r", "x")
    b = correlations(synthetic, columns).withColumnRenamed("r", "y")
    n = len(columns)
    return a.join(b, ["a", "b"]).agg(
        (F.sum(F.abs(F.col("x") - F.col("y"))) * 2 / (n * n)).alias("mad"), F.corr("x", "y").alias("meta_correlation")
    )


def paired_t(df: DataFrame, x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    s, n = F.stddev(d), F.count(d)
    return df.agg(
        n.alias("n"), F.avg(d).alias("mean_difference"), s.alias("sd"), (F.avg(d) / (s / F.sqrt(n))).alias("t"),
        (F.avg(d) / s).alias("cohens_d"),
        (F.avg(d) - 1.96 * s / F.sqrt(n)).alias("low"), (F.avg(d) + 1.96 * s / F.sqrt(n)).alias("high"),
    )


def bland_altman(df: DataFrame, x: str, y: str) -> DataFrame:
    d, m = F.col(x) - F.col(y), (F.col(x) + F.col(y)) / 2
    bias, s = F.avg(d), F.stddev(d)
    return df.agg(
        F.count(d).alias("n"), bias.alias("bias"), s.alias("sd"), (bias - 1.96 * s).alias("lower"), (bias + 1.96 * s).alias("upper"),
        (1.96 * s).alias("repeatability"), (100 * bias / F.avg(m)).alias("percent_bias"), (100 * 1.96 * s / F.avg(m)).alias("percent_error"),
    )


def concordance(df: DataFrame, x: str, y: str) -> DataFrame:
    """Lin's concordance correlation coefficient."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ccc = 2 * F.covar_samp(x, y) / (F.var_samp(x) + F.var_samp(y) + (F.avg(x) - F.avg(y)) ** 2)
    return both.agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), ccc.alias("ccc"))


def concordance_bootstrap(df: DataFrame, x: str, y: str, key: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of the coefficient by a Poisson bootstrap: each row enters a round as often
    as the hash xxhash64(key, round, seed) says. Rows aren't copied by round: a task draws all rounds of a block of rows at once, and adds
    up its sums, so what moves is a row per round and task."""
    steps = [math.floor(p * (1 << 30)) for p in _poisson_steps()]
    names = ["n", "sx", "sy", "xx", "yy", "xy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((rounds, len(names)))
        number = np.arange(1, rounds + 1)
        for batch in batches:
            v, w = batch["x"].to_numpy(float), batch["y"].to_numpy(float)
            terms = np.stack([np.ones(len(v)), v, w, v * v, w * w, v * w], axis=1)
            whole = np.isfinite(terms).all(axis=1)
            for lo in range(0, len(batch), 128):
                part, fine = terms[lo : lo + 128], whole[lo : lo + 128]
                h = _hash_next(batch["h"].to_numpy(np.int64)[lo : lo + 128].view(np.uint64)[None, :], number[:, None])
                bits = (_hash_next(h, np.array([[seed]])) & np.uint64((1 << 30) - 1)).astype(np.int32)
                times = np.zeros(bits.shape, np.int8)
                for step in steps:
                    times += bits > step
                sums += times[:, fine].astype(float) @ part[fine]
                for k in np.flatnonzero(~fine):  # these count only where they are drawn
                    drawn = times[:, k] > 0
                    sums[drawn] += times[drawn, k, None] * part[k]
        yield pd.DataFrame(sums, columns=names).assign(round=number)

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    drawn = rows.mapInPandas(run, ", ".join(f"{c} double" for c in names) + ", round int")
    s = drawn.groupBy("round").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0")
    cov = F.col("xy") / F.col("n") - F.col("sx") * F.col("sy") / F.col("n") ** 2
    var = [F.col(k * 2) / F.col("n") - (F.col(f"s{k}") / F.col("n")) ** 2 for k in ("x", "y")]
    c = 2 * cov / (var[0] + var[1] + ((F.col("sx") - F.col("sy")) / F.col("n")) ** 2)
    return s.select(c.alias("c")).agg(F.percentile("c", 0.025).alias("low"), F.percentile("c", 0.975).alias("high"))


def _hash_next(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """XXH64 of ints with the hashes so far as seeds: what F.xxhash64 does for its next column."""
    one, two, three, five = (np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (h + (five + np.uint64(4))) ^ ((value.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * one)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
    h ^= h >> np.uint64(33)
    h *= two
    h ^= h >> np.uint64(29)
    h *= three
    h ^= h >> np.uint64(32)
    return h


def _poisson_steps(most: int = 10) -> list[float]:
    out, p, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += p
        out.append(total)
        p /= k + 1
    return out


def intraclass(df: DataFrame, x: str, y: str) -> DataFrame:
    """ICC(2,1) and ICC(2,k) of two raters from two-way sums of squares."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    s = both.agg(
        F.count("*").cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop((F.col("x") + F.col("y")) / 2).alias("vm"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
    )
    n, g = F.col("n"), (F.col("mx") + F.col("my")) / 2
    rows = 2 * n * F.col("vm")
    columns = n * ((F.col("mx") - g) ** 2 + (F.col("my") - g) ** 2)
    total = n * (F.col("vx") + F.col("vy")) + columns
    msr, msc, mse = rows / (n - 1), columns, (total - rows - columns) / (n - 1)
    return s.select(
        F.col("n").cast("long").alias("n"),
        ((msr - mse) / (msr + mse + 2 * (msc - mse) / n)).alias("icc_single"),
        ((msr - mse) / (msr + (msc - mse) / n)).alias("icc_average"),
    )


def deming(df: DataFrame, x: str, y: str, ratio: float = 1.0) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.agg(F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.covar_samp(x, y).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = F.col("yy") - ratio * F.col("xx")
    slope = (d + F.sqrt(d * d + 4 * ratio * F.col("xy") ** 2)) / (2 * F.col("xy"))
    return s.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def signed_rank(df: DataFrame, x: str, y: str) -> DataFrame:
    """Wilcoxon's W+ and W-, ties at their average rank, zero differences left out. Ranks come from
    running counts of distinct absolute differences."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d is not null and d != 0")
    per = d.groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("plus"))
    ranked = running_sums(per, "a", {"cum": "n"})
    rank = F.col("cum") - (F.col("n") - 1) / 2.0
    return ranked.agg(
        F.sum("n").alias("n"), F.sum(rank * F.col("plus")).alias("w_plus"), F.sum(rank * (F.col("n") - F.col("plus"))).alias("w_minus")
    )


def pseudo_median(df: DataFrame, x: str, y: str, bits: int = 40) -> DataFrame:
    """Hodges-Lehmann estimate: the median of the means of all pairs of differences (a difference with itself
    included). The pairs are never made: differences become integers on a grid of 2^bits steps from the least to the
    largest, and the median is searched by counting pairs below some candidates, each round by running
    counts over the distinct differences. Exact on the grid, whose step is 10^-12 of the span."""
    d = df.select((F.col(x) - F.col(y)).cast("double").alias("d")).where("d is not null and not isnan(d)")
    low, high, n = d.agg(F.min("d"), F.max("d"), F.count("*")).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([(None,)], "pseudo_median double")
    step = (high - low) / (1 << bits)
    if not step:
        return spark.createDataFrame([(low,)], "pseudo_median double")
    grid = d.select(F.round((F.col("d") - F.lit(low)) / F.lit(step)).cast("long").alias("v"))
    counts = materialize(grid.groupBy("v").agg(F.count("*").alias("n")))
    pairs = n * (n + 1) // 2
    first, below = _pair_sum(counts, (pairs + 1) // 2, -1, 0, 2 << bits, pairs)
    # of an even number of pairs the next one counts as well, which mostly has the same sum
    second = first if below > pairs // 2 else _pair_sum(counts, pairs // 2 + 1, first, below, 2 << bits, pairs)[0]
    sums = [first, second]
    return spark.createDataFrame([(low + step * sum(sums) / len(sums) / 2,)], "pseudo_median double")


def _pairs_below(counts: DataFrame, limits: Sequence[int]) -> dict[int, int]:
    """For each limit the number of pairs i <= j with v_i + v_j <= limit. counts: v, n. For each v the values up to
    limit - v are counted by a running sum over values and questions together."""
    asked = counts.select(F.explode(F.array(*[F.lit(t) for t in limits])).alias("t"), "v", "n")
    both = counts.select(F.col("v").alias("at"), F.col("n").alias("here"), F.lit(None).cast("long").alias("t"), F.lit(0).cast("long").alias("q")).unionByName(
        asked.select((F.col("t") - F.col("v")).alias("at"), F.lit(0).cast("long").alias("here"), "t", F.col("n").alias("q"))
    )
    of = [F.sum(F.when(F.col("t") == t, F.col("q")).otherwise(0)).alias(f"q{k}") for k, t in enumerate(limits)]
    run = running_sums(both.groupBy("at").agg(F.sum("here").alias("here"), *of), "at", {"below": "here"})
    ordered = run.agg(*[F.sum((F.col(f"q{k}") * F.col("below")).cast("decimal(38,0)")).alias(f"c{k}") for k in range(len(limits))]).first()
    own = counts.agg(*[F.coalesce(F.sum(F.when(2 * F.col("v") <= t, F.col("n"))), F.lit(0)).alias(f"c{k}") for k, t in enumerate(limits)]).first()
    return {t: (int(ordered[k]) + int(own[k])) // 2 for k, t in enumerate(limits)}


def _pair_sum(counts: DataFrame, rank: int, low: int, below: int, high: int, total: int) -> tuple[int, int]:
    """(sum, pairs up to it) of the pair of that rank, from 1, given that `below` pairs have a sum up to low and `total` one up to high. Seven
    candidates divide the interval by eight, three more lie around the interpolated place, where it mostly is."""
    while high - low > 1:
        share = (rank - below) / max(total - below, 1)
        near = low + int((high - low) * share)
        width = max(1, (high - low) // 512)
        asked = {low + (high - low) * k // 8 for k in range(1, 8)} | {near - width, near, near + width}
        for t, c in sorted(_pairs_below(counts, sorted(t for t in asked if low < t < high)).items()):
            if c >= rank:
                high, total = t, c
                break
            low, below = t, c
    return high, total


#: Bits of a rank that one round of kendall_tau looks at.
DIGIT = 4


def discordant_pairs(points: DataFrame) -> int:
    """Pairs of points (x, y, n: how often) with a smaller x and a larger y. Ranks of y are compared digit by digit: two ranks first differ in one
    digit, so each round takes points with equal higher digits in the order of x, and for each one the points before
    it with a larger digit are counted by running sums over ranges. No group is gathered, and the rounds
    are as many as the ranks have digits."""
    ranks = global_index(points.select("y").distinct(), ["y"], "rank")
    held = materialize(points.join(ranks, "y").select("x", "rank", "n"))
    top = held.agg(F.max("rank")).first()[0]
    base, found, shift = 1 << DIGIT, 0, 0
    while top is not None and top >> shift:
        high, digit = F.shiftright("rank", shift + DIGIT).alias("high"), F.shiftright("rank", shift).bitwiseAND(base - 1).alias("digit")
        # equal x never count, and so stand together: one row per (high, x), with how many of each digit
        per = held.select("x", "n", high, digit).groupBy("high", "x").agg(*[F.sum(F.when(F.col("digit") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in range(base)])
        per = materialize(per)
        run = running_sums(per, ["high", "x"], {f"c{d}": f"n{d}" for d in range(1, base)})
        # of the running counts, those of the groups before don't count
        groups = per.groupBy("high").agg(*[F.sum(f"n{d}").alias(f"n{d}") for d in range(base)])
        starts = running_sums(groups, "high", {f"c{d}": f"n{d}" for d in range(1, base)})
        ahead = [(F.col(f"c{e}") - F.col(f"n{e}"), F.col(f"n{d}")) for d in range(base) for e in range(d + 1, base)]
        total = reduce(lambda a, b: a + b, [x.cast("decimal(38,0)") * y for x, y in ahead])
        inner, outer = (int(t.agg(F.sum(total)).first()[0] or 0) for t in (run, starts))
        found += inner - outer
        shift += DIGIT
    return found


def kendall_tau(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """n, tau (b, with ties) and the two-sided p-value: exact for up to 33 pairs without ties, else by the normal approximation. Rows with a
    NULL or NaN are left out; fewer than two rows, or a side that doesn't vary, have tau NaN and p NaN."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    points = materialize(rows.groupBy("x", "y").agg(F.count("*").alias("n")))

    def ties(*keys: str) -> tuple[int, int, int]:
        n = F.col("n").cast("decimal(38,0)")
        sums = points.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.sum(n * (n - 1)), F.sum(n * (n - 1) * (n - 2)), F.sum(n * (n - 1) * (2 * n + 5))).first()
        return tuple(int(v or 0) for v in sums)

    n = int(points.agg(F.sum("n")).first()[0] or 0)
    (x1, x2, x3), (y1, y2, y3), (both, _, _) = ties("x"), ties("y"), ties("x", "y")
    pairs = n * (n - 1)
    if not (pairs - x1) * (pairs - y1):
        return {"n": n, "tau": math.nan, "p": math.nan}
    apart = discordant_pairs(points)
    score = (pairs - x1 - y1 + both) // 2 - 2 * apart
    tau = score / math.sqrt((pairs - x1) / 2 * ((pairs - y1) / 2))
    if not x1 and not y1 and n <= 33:
        counts = [1]  # permutations by inversions
        for m in range(2, n + 1):
            counts = [sum(counts[max(0, k - m + 1) : k + 1]) for k in range(len(counts) + m - 1)]
        tail = sum(counts[: min(apart, pairs // 2 - apart) + 1])
        return {"n": n, "tau": tau, "p": min(1.0, 2 * tail / math.factorial(n))}
    spread = (pairs * (2 * n + 5) - x3 - y3) / 18 + x1 * y1 / (2 * pairs) + (x2 * y2 / (9 * pairs * (n - 2)) if n > 2 else 0)
    return {"n": n, "tau": tau, "p": math.erfc(abs(score) / math.sqrt(spread) / math.sqrt(2)) if spread > 0 else math.nan}


def t_p_value(t: float, degrees: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isnan(t):
        return math.nan
    return _beta_share(degrees / (degrees + t * t), degrees / 2, 0.5)


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f = c = 1.0
    d = 0.0
    for i in range(500):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def signed_rank_test(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """The smaller of W+ and W-, its normal approximation with the correction for ties, the two-sided p-value and
    the effect size z / sqrt(n) over all pairs."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d is not null")
    per = d.where("d != 0").groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("plus"))
    per = materialize(per)
    rank = F.col("cum") - (F.col("n") - 1) / 2.0
    cubes = F.sum(F.pow("n", F.lit(3)) - F.col("n"))
    row = running_sums(per, "a", {"cum": "n"}).agg(
        F.sum("n"), F.sum(rank * F.col("plus")), F.sum(rank * (F.col("n") - F.col("plus"))), cubes
    ).first()
    n, plus, minus, ties = (float(v or 0) for v in row)
    w = min(plus, minus)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    z = (w - n * (n + 1) / 4) / spread if spread else 0.0
    p = math.erfc(abs(z) / math.sqrt(2))
    return {"w": w, "z": z, "p": p, "effect": abs(z) / math.sqrt(max(d.count(), 1))}


@F.pandas_udf(DoubleType())
def normal_share(z: pd.Series) -> pd.Series:
    """The standard normal distribution function."""
    return pd.Series([0.5 * math.erfc(-v / math.sqrt(2)) for v in z.to_numpy(float)])


#: Fixed values of Royston's approximation (AS R94) of the Shapiro-Wilk test: polynomials, constant first.
SHAPIRO_A1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SHAPIRO_A2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SHAPIRO_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SHAPIRO_SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
SHAPIRO_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SHAPIRO_SPREAD = (-0.4803, -0.082676, 0.0030302)
#: Values up to which that test is used; larger samples take the Kolmogorov-Smirnov distance.
SHAPIRO_MOST = 5000


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and its p-value for 3 to 5,000 values."""

    def poly(c: Sequence[float], v: float) -> float:
        return sum(k * v**i for i, k in enumerate(c))

    x = sorted(values)
    n = len(x)
    normal = statistics.NormalDist()
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = m[-1] / math.sqrt(square) + poly(SHAPIRO_A1, u)
        if n > 5:
            second = m[-2] / math.sqrt(square) + poly(SHAPIRO_A2, u)
            rest = math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
            a = [-last, -second, *[v / rest for v in m[2:-2]], second, last]
        else:
            rest = math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a = [-last, *[v / rest for v in m[1:-1]], last]
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    if not spread:
        return 1.0, 1.0
    w = min(sum(k * v for k, v in zip(a, x, strict=True)) ** 2 / spread, 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w == 1:
        return w, 1.0
    log = math.log(n)
    if n <= 11:
        z = (-math.log(max(-2.273 + 0.459 * n - math.log1p(-w), 1e-300)) - poly(SHAPIRO_SMALL_MEAN, n)) / math.exp(poly(SHAPIRO_SMALL_SPREAD, n))
    else:
        z = (math.log1p(-w) - poly(SHAPIRO_MEAN, log)) / math.exp(poly(SHAPIRO_SPREAD, log))
    return w, 1 - normal.cdf(z)


def normality(df: DataFrame, column: str) -> dict[str, object]:
    """The test of normality that the size allows: Shapiro-Wilk up to SHAPIRO_MOST values, whose number bounds what
    reaches the driver, else the Kolmogorov-Smirnov distance from the fitted normal distribution."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, mean, sd = v.agg(F.count("*"), F.avg("v"), F.stddev("v")).first()
    if n < 3 or not sd:
        return {"test": None, "statistic": None, "p": None}
    if n <= SHAPIRO_MOST:
        w, p = shapiro_wilk([r["v"] for r in v.collect()])
        return {"test": "shapiro_wilk", "statistic": w, "p": p}
    per = v.groupBy("v").agg(F.count("*").alias("n"))
    run = running_sums(per, "v", {"cum": "n"}).withColumn("f", normal_share((F.col("v") - F.lit(mean)) / F.lit(sd)))
    gap = F.greatest(F.col("cum") / n - F.col("f"), F.col("f") - (F.col("cum") - F.col("n")) / n)
    d = run.agg(F.max(gap)).first()[0]
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * n * d * d) for k in range(1, 101)) if d * math.sqrt(n) > 0.2 else 1.0
    return {"test": "kolmogorov_smirnov", "statistic": d, "p": min(max(p, 0.0), 1.0)}


def compare_methods(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: two methods on the same cases by every test, and whether one may stand for the other."""
    both = materialize(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y")))
    t, ba = paired_t(both, "x", "y").first(), bland_altman(both, "x", "y").first()
    lin, icc = concordance(both, "x", "y").first(), intraclass(both, "x", "y").first()
    w = signed_rank_test(both, "x", "y")
    shape = normality(both.select((F.col("x") - F.col("y")).alias("d")), "d")
    skew = both.agg(F.skewness(F.col("x") - F.col("y")), F.kurtosis(F.col("x") - F.col("y"))).first()
    row = {
        "n": t["n"], "mean_difference": t["mean_difference"], "t": t["t"], "t_p": t_p_value(t["t"], t["n"] - 1), "cohens_d": t["cohens_d"],
        "w": w["w"], "w_p": w["p"], "effect_size_r": w["effect"], "normality_test": shape["test"], "normality": shape["statistic"],
        "normality_p": shape["p"], "skewness": skew[0], "kurtosis": skew[1], "percent_bias": ba["percent_bias"], "ccc": lin["ccc"], "icc": icc["icc_single"],
    }
    kinds = {"n": "long", "normality_test": "string"}
    one = df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in row))
    verdict = interchangeable(*[F.col(c) for c in ("t_p", "w_p", "percent_bias", "ccc", "icc")])
    return one.withColumn("interchangeable", verdict)


def label_disagreement(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: cases that both methods label, and those they label differently."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count("*").alias("n"), F.count_if(F.col(x) != F.col(y)).alias("different"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    agg = df.agg(*[F.struct(F.skewness(c).alias("s"), F.kurtosis(c).alias("k")).alias(c) for c in columns])
    return agg.unpivot([], list(columns), "variable", "v").select("variable", F.col("v.s").alias("skewness"), F.col("v.k").alias("kurtosis"))


def interchangeable(t_p: Column, w_p: Column, percent_bias: Column, ccc: Column, icc: Column) -> Column:
    return (t_p > 0.05) & (w_p > 0.05) & (F.abs(percent_bias) <= 10) & (ccc >= 0.95) & (icc >= 0.75)


def kl_divergence(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """Sum of p ln(p / q) over classes both have."""
    from visitframe.operators.profiling import class_shares

    both = class_shares(real, synthetic, column).where("real_share > 0 and synthetic_share > 0")
    return both.agg(F.sum(F.col("real_share") * F.log(F.col("real_share") / F.col("synthetic_share"))).alias("kl"))


def auc_by_class(df: DataFrame, label: str, scores: Sequence[tuple[object, str]]) -> DataFrame:
    """(class, auc) one against the rest, from rank sums; ties count half."""
    out = []
    for value, score in scores:
        per = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.lit(value)).alias("p"))
        ranked = running_sums(per, "s", {"cum": "n"})
        ranks = F.sum((F.col("cum") - (F.col("n") - 1) / 2.0) * F.col("p"))
        p, n = F.sum("p"), F.sum("n")
        out.append(ranked.agg(((ranks - p * (p + 1) / 2) / (p * (n - p))).alias("auc")).select(F.lit(str(value)).alias("class"), "auc"))
    return reduce(DataFrame.unionByName, out)


def trajectory_difference(real: DataFrame, synthetic: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Means and deviations per group of both sides and whether they differ by less than a fifth of
    the real deviation."""
    a = real.groupBy(*group).agg(F.avg(column).alias("real_mean"), F.stddev(column).alias("real_std"))
    b = synthetic.groupBy(*group).agg(F.avg(column).alias("synthetic_mean"), F.stddev(column).alias("synthetic_std"))
    near = F.abs(F.col("real_mean") - F.col("synthetic_mean")) < 0.2 * F.col("real_std")
    return a.join(b, list(group)).withColumn("close", near)


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients from constant to highest by pyspark.ml least squares."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    powers = [f"__p{k}" for k in range(1, degree + 1)]
    grown = df.withColumns({p: F.pow(F.col(x).cast("double"), F.lit(k + 1)) for k, p in enumerate(powers)})
    ready = VectorAssembler(inputCols=powers, outputCol="__x").transform(grown)
    model = LinearRegression(featuresCol="__x", labelCol=y, solver="normal").fit(ready)
    return [model.intercept, *model.coefficients]


def log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, intercept, slope, mse, r2) of the least-squares line of y over ln x; rows without both, or with x not above 0, are left out. One
    aggregate, from whose moments the errors follow."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x > 0 and y is not null and not isnan(x) and not isnan(y)")
    sums = rows.select(F.log("x").alias("u"), "y").agg(
        F.count("*").alias("n"), F.avg("u").alias("mu"), F.avg("y").alias("my"), F.var_pop("u").alias("uu"), F.var_pop("y").alias("yy"), F.covar_pop("u", "y").alias("uy")
    )
    slope = F.try_divide("uy", "uu")
    lost = F.greatest(F.col("yy") - F.col("uy") * slope, F.lit(0.0))
    return sums.select("n", (F.col("my") - slope * F.col("mu")).alias("intercept"), slope.alias("slope"), lost.alias("mse"), (1 - F.try_divide(lost, F.col("yy"))).alias("r2"))


def predict_log(df: DataFrame, x: str, fit: DataFrame, out: str) -> DataFrame:
    """df with the value of a fitted line (one row of log_fit) at x, inside or outside of what it was fitted on."""
    line = fit.select(F.col("intercept").alias("__a"), F.col("slope").alias("__b"))
    return df.crossJoin(F.broadcast(line)).withColumn(out, F.col("__a") + F.col("__b") * F.log(F.col(x).cast("double"))).drop("__a", "__b")


def predict_polynomial(df: DataFrame, x: str, coefficients: Sequence[float], out: str) -> DataFrame:
    """df with the polynomial's value at x (coefficients from constant to highest), by Horner's rule."""
    value = reduce(lambda total, c: total * F.col(x).cast("double") + F.lit(float(c)), reversed(coefficients), F.lit(0.0))
    return df.withColumn(out, value)


def duration_parts(df: DataFrame, seconds: str) -> DataFrame:
    """df with days, hours, minutes and seconds of a number of seconds."""
    s = F.col(seconds)
    parts = {"days": F.floor(s / 86400), "hours": F.floor(F.pmod(s, F.lit(86400)) / 3600), "minutes": F.floor(F.pmod(s, F.lit(3600)) / 60), "seconds": F.pmod(s, F.lit(60))}
    return df.withColumns(parts)
