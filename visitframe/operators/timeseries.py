"""Tests of single subjects' series: unit roots, stationarity, autocorrelation, orders.

No series is gathered. Its values are numbered in order, cut in blocks of BLOCK values, each with those before it that
the largest lag reaches, and a block yields sums of lagged products. These add up per subject, and with the
first and last few values of the series they give every moment matrix that the tests solve, however the sample is cut.
A subject with a third of all rows is thus spread over as many tasks as it has blocks; what is solved
per subject has the size of the lags.

Values that are null or not numbers are passed over; equal times are ordered by value; a NULL subject is none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from visitframe.operators.ordering import place_in_group
from visitframe.session import materialize

#: MacKinnon's (1994) response surface for a constant and one series.
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
#: KPSS (1992) critical values for a level, and their p-values.
KPSS_VALUES, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


#: Values of a series that one task works on; more, if the largest lag is longer.
BLOCK = 1 << 12
#: Sums of one block or one subject: name, lag or place, value.
Sums = list[tuple[str, int, float]]


def dickey_fuller_p(t: float) -> float:
    if t > TAU_MAX:
        return 1.0
    if t < TAU_MIN:
        return 0.0
    poly = TAU_SMALL if t <= TAU_STAR else TAU_LARGE
    return 0.5 * math.erfc(-sum(c * t**k for k, c in enumerate(poly)) / math.sqrt(2))


def schwert(n: int) -> int:
    return math.ceil(12 * (n / 100) ** 0.25)


# ------------------------------------------------------------------ blocks


def numbered(df: DataFrame, subject: str, time: str, value: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(values, subjects): (s, pos, v) of the series of at least `least` values, and (s, n, mean, varies) of their subjects."""
    rows = df.select(F.col(subject).alias("s"), F.col(time).alias("t"), F.col(value).cast("double").alias("v"))
    rows = rows.where("s is not null and v is not null and not isnan(v)")
    placed = place_in_group(rows, "s", ["t", "v"], "pos").select("s", "pos", "v")
    info = placed.groupBy("s").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.max("v") > F.min("v")).alias("varies"))
    return placed, materialize(info.where(F.col("n") >= least))


def in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_of: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str
) -> DataFrame:
    """The rows that `rows_of` makes of each group of equal keys, whose columns it gets as arrays, in order. Rows are dealt by a hash of
    the keys: behind a join on the keys themselves Spark leaves the exchange out, and a join that turns into a broadcast
    at run time then reads its shuffle where it lies, with a group in many tasks."""
    dealt = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(t: pa.Table, last: bool) -> tuple[list[tuple], int]:
            """Rows of the whole groups of t, of the last group too if there is nothing behind it, and where the rest begins."""
            columns = {c: t[c].to_numpy() for c in names}
            new = np.zeros(len(t) - 1, bool)
            for c in keys:
                new |= columns[c][1:] != columns[c][:-1]
            at = [0, *(np.flatnonzero(new) + 1).tolist(), len(t)]
            stop = len(at) - 1 if last else len(at) - 2
            return [row for lo, hi in zip(at[:stop], at[1:], strict=False) for row in rows_of({c: v[lo:hi] for c, v in columns.items()})], at[stop]

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held):
                rows, rest = made(held, False)
                held = held.slice(rest)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_columns(rows), types, strict=True)], names=out)
        if held is not None and len(held):
            rows, _ = made(held, True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_columns(rows), types, strict=True)], names=out)

    def _columns(rows: list[tuple]) -> list[tuple]:
        return list(zip(*rows, strict=True)) if rows else [()] * len(out)

    fields = to_arrow_schema(StructType.fromDDL(schema))
    out, types = fields.names, fields.types
    return dealt.mapInArrow(run, schema)


def by_blocks(
    values: DataFrame, info: DataFrame, halo: int, sums: Callable[[dict, int, np.ndarray, np.ndarray, int], Sums]
) -> DataFrame:
    """(s, name, k, value), added up over the blocks of each subject of info. `sums` gets the subject's info, the block's number, the places and
    centred values of the block with `halo` values before it, and which of these is the block's first own one."""
    size = max(BLOCK, halo)
    block = F.floor(F.col("pos") / size)
    blocks = F.when(F.col("pos") % size >= size - halo, F.array(block, block + 1)).otherwise(F.array(block))
    spread = info.where("varies").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))))
    joined = values.withColumn("block", F.explode(blocks)).join(spread, ["s", "block"])

    def run(g: dict[str, np.ndarray]) -> list[tuple]:
        first = {c: v[0] for c, v in g.items()}
        start = first["block"] * size
        found = sums(first, int(first["block"]), g["pos"], g["v"] - first["mean"], int(np.searchsorted(g["pos"], start)))
        return [(first["s"], *row) for row in found]

    parts = in_groups(joined, ["s", "block"], ["pos"], run, f"s {dict(values.dtypes)['s']}, name string, k long, value double")
    return parts.groupBy("s", "name", "k").agg(F.sum("value").alias("value"))


def per_subject(info: DataFrame, sums: DataFrame, solve: Callable[[dict, dict[str, np.ndarray]], Sequence[float | None]], names: Sequence[str]) -> DataFrame:
    """(s, n, names): `solve` of each subject's info and sums, which come as arrays by name, lag after lag. A series that doesn't vary has NULLs."""
    columns = [c for c in info.columns if c != "s"]
    rows = sums.join(info, "s")

    def run(g: dict[str, np.ndarray]) -> list[tuple]:
        name = g["name"]
        at = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
        own = {name[lo]: g["value"][lo:hi] for lo, hi in zip(at, at[1:], strict=False)}
        found = solve({c: g[c][0] for c in columns}, own)
        return [(g["s"][0], int(g["n"][0]), *[None if v is None or math.isnan(v) else float(v) for v in found])]

    schema = f"s {dict(info.dtypes)['s']}, n long, " + ", ".join(f"{c} double" for c in names)
    solved = in_groups(rows, ["s"], ["name", "k"], run, schema)
    flat = info.where("not varies").select("s", "n", *[F.lit(None).cast("double").alias(c) for c in names])
    return solved.unionByName(flat)


def largest(info: DataFrame, of: Callable[[int], int]) -> int:
    """`of` the longest series."""
    return of(info.agg(F.max("n")).first()[0] or 0)


def lagged(name: str, u: np.ndarray, w: np.ndarray, own: int, lags: int) -> Sums:
    """Sums of u[t] * w[t - k] over the own t, for k from 0 to lags; both start at the same place."""
    out = []
    for k in range(lags + 1):
        lo = max(own, k)
        out.append((name, k, float(u[lo:] @ w[lo - k : len(w) - k]) if lo < len(u) else 0.0))
    return out


def ends(pos: np.ndarray, v: np.ndarray, own: int, n: int, most: int) -> Sums:
    """The first and the last `most` values of the series, as far as they are the block's own."""
    at = np.arange(len(pos)) >= own
    first, last = at & (pos < most), at & (pos >= n - most)
    return [("head", int(p), float(x)) for p, x in zip(pos[first], v[first], strict=True)] + [
        ("tail", int(p - max(n - most, 0)), float(x)) for p, x in zip(pos[last], v[last], strict=True)
    ]


def cut_products(full: np.ndarray, head: np.ndarray, tail: np.ndarray, skip: int, lags: int) -> np.ndarray:
    """Matrix of the sums over i >= skip of x[i - a] * x[i - b] for a and b from 0 to lags <= skip, from the sums `full` of x[t] * x[t - k]
    over all t >= k, the first `skip` and the last `lags` values of x."""
    out = np.empty((lags + 1, lags + 1))
    m = len(tail)
    for a in range(lags + 1):
        for b in range(a, lags + 1):
            k = b - a
            lost = float(head[k : skip - a] @ head[: skip - a - k]) if skip - a > k else 0.0
            late = tail[m - a :] @ tail[m - a - k : m - k] if a else 0.0
            out[a, b] = out[b, a] = full[k] - lost - float(late)
    return out


def fitted(gram: np.ndarray, cross: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse of the moment matrix and residual sum of squares of a least-squares fit."""
    inverse = np.linalg.pinv(gram)
    beta = inverse @ cross
    return beta, inverse, max(float(square - 2 * beta @ cross + beta @ gram @ beta), 0.0)


# ------------------------------------------------------------------- tests


def adf_lags(n: int) -> int:
    return max(0, min(schwert(n), n // 2 - 2))


def _adf_sums(info: dict, block: int, pos: np.ndarray, v: np.ndarray, own: int) -> Sums:
    n = int(info["n"])
    most = adf_lags(n)
    # d[j] is the step to the value at j + 1 of the block and belongs to it; level[j] is the value before
    d, level, first = np.diff(v), v[:-1], max(own - 1, 0)
    out = lagged("dd", d, d, first, most) + lagged("yd", level, d, first, most)
    out += [("yy", 0, float(level[first:] @ level[first:])), ("y", 0, float(level[first:].sum()))]
    return out + ends(pos, v, own, n, most + 2)


def _adf_solve(info: dict, s: dict[str, np.ndarray]) -> tuple[float, float, int]:
    n = int(info["n"])
    most = adf_lags(n)
    steps = n - 1
    head, tail = s["head"], s["tail"]
    head_d, tail_d = np.diff(head), np.diff(tail)

    def moments(skip: int, lags: int) -> tuple[np.ndarray, np.ndarray, float, int]:
        products = cut_products(s["dd"], head_d, tail_d, skip, lags)
        rows = steps - skip
        level = np.array([s["yd"][b] - head[b:skip] @ head_d[: max(skip - b, 0)] for b in range(lags + 1)])
        total = s["y"][0] - head[:skip].sum()
        # sums of steps telescope
        sums = np.array([tail[len(tail) - 1 - b] - head[skip - b] for b in range(lags + 1)])
        gram = np.empty((lags + 2, lags + 2))
        gram[0, 0] = s["yy"][0] - head[:skip] @ head[:skip]
        gram[0, 1:-1] = gram[1:-1, 0] = level[1:]
        gram[1:-1, 1:-1] = products[1:, 1:]
        gram[0, -1] = gram[-1, 0] = total
        gram[1:-1, -1] = gram[-1, 1:-1] = sums[1:]
        gram[-1, -1] = rows
        return gram, np.array([level[0], *products[0, 1:], sums[0]]), products[0, 0], rows

    best, chosen = math.inf, 0
    gram, cross, square, rows = moments(most, most)
    for lags in range(most + 1):
        if rows <= lags + 2:
            break
        at = [*range(lags + 1), most + 1]
        rss = fitted(gram[np.ix_(at, at)], cross[at], square)[2]
        aic = rows * (math.log(max(rss, 1e-300) / rows) + math.log(2 * math.pi) + 1) + 2 * (lags + 2)
        if aic < best - 1e-12:
            best, chosen = aic, lags
    gram, cross, square, rows = moments(chosen, chosen)
    beta, inverse, rss = fitted(gram, cross, square)
    free = rows - len(cross)
    if free <= 0 or rss <= 0:
        return math.nan, math.nan, chosen
    t = beta[0] / math.sqrt(rss / free * inverse[0, 0])
    return t, dickey_fuller_p(t), chosen


def adf_per_subject(df: DataFrame, subject: str, time: str, value: str, least: int = 8) -> DataFrame:
    """(subject, n, statistic, p_value, lags, stationary) of the augmented Dickey-Fuller test with a constant; lags by AIC."""
    return _adf_of(*numbered(df, subject, time, value, least)).withColumnRenamed("s", subject)


def _adf_of(values: DataFrame, info: DataFrame) -> DataFrame:
    sums = by_blocks(values, info, largest(info, lambda n: schwert(n) + 2), _adf_sums)
    found = per_subject(info, sums, _adf_solve, ["statistic", "p_value", "lags"])
    return found.withColumn("stationary", F.col("p_value") < 0.05)


def kpss_per_subject(df: DataFrame, subject: str, time: str, value: str, least: int = 3) -> DataFrame:
    """(subject, n, statistic, p_value, lags, stationary) of the KPSS test for a level; p-values lie between 0.01 and 0.1. A first
    pass finds how many lags the long-run variance takes, a second one adds them up."""
    return _kpss_of(*numbered(df, subject, time, value, least)).withColumnRenamed("s", subject)


def _kpss_of(values: DataFrame, info: DataFrame) -> DataFrame:
    def lags_of(n: int) -> int:
        return int(n ** (2 / 9))

    def first(info: dict, block: int, pos: np.ndarray, v: np.ndarray, own: int) -> Sums:
        c = np.cumsum(v[own:])
        running = [("count", block, len(c)), ("sum", block, c[-1]), ("running", block, c.sum()), ("squares", block, c @ c)]
        return lagged("rr", v, v, own, lags_of(int(info["n"]))) + [(n, k, float(x)) for n, k, x in running]

    sums = materialize(by_blocks(values, info, largest(info, lags_of), first))

    def choose(info: dict, s: dict[str, np.ndarray]) -> tuple[float, float]:
        n, rr = int(info["n"]), s["rr"]
        s0 = rr[0] / n + sum(rr[1:]) / (n / 2)
        s1 = sum(k * x for k, x in enumerate(rr)) / (n / 2)
        return (min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0), rr[0]

    lags = per_subject(info, sums.where("name = 'rr'"), choose, ["lags", "total"]).drop("n")
    # partial sums of a block start from the sum of the blocks before
    pivoted = sums.where("name != 'rr'").groupBy("s", "k").agg(*[F.sum(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in ("count", "sum", "running", "squares")])
    before = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("sum").over(before), F.lit(0.0))
    partial = pivoted.withColumn("start", start).groupBy("s").agg(
        F.sum(F.col("count") * F.col("start") ** 2 + 2 * F.col("start") * F.col("running") + F.col("squares")).alias("partial")
    )
    known = materialize(info.join(lags, "s").join(partial, "s", "left"))

    def second(info: dict, block: int, pos: np.ndarray, v: np.ndarray, own: int) -> Sums:
        own_lags = int(info["lags"] or 0)
        return [("weighted", 0, sum(x * (1 - k / (own_lags + 1)) for _, k, x in lagged("", v, v, own, own_lags) if k))]

    def statistic(info: dict, s: dict[str, np.ndarray]) -> tuple[float, float, float]:
        n, long_run = int(info["n"]), info["total"] + 2 * s["weighted"][0]
        if long_run <= 0:
            return math.nan, math.nan, info["lags"]
        stat = info["partial"] / n**2 / (long_run / n)
        return stat, float(np.interp(stat, KPSS_VALUES, KPSS_P)), info["lags"]

    most = int(known.agg(F.max("lags")).first()[0] or 0)
    found = per_subject(known, by_blocks(values, known, most, second), statistic, ["statistic", "p_value", "lags"])
    return found.withColumn("stationary", F.col("p_value") >= 0.05)


def autocorrelations(df: DataFrame, subject: str, time: str, value: str, lags: int, least: int, solve: Callable[[np.ndarray], Sequence[float]], names: Sequence[str]) -> DataFrame:
    """(subject, n, names): `solve` of each series' autocorrelations up to `lags`."""
    values, info = numbered(df, subject, time, value, least)

    def sums(info: dict, block: int, pos: np.ndarray, v: np.ndarray, own: int) -> Sums:
        return lagged("rr", v, v, own, min(lags, int(info["n"]) - 1))

    def solved(info: dict, s: dict[str, np.ndarray]) -> Sequence[float]:
        rho = np.full(lags + 1, math.nan)
        rho[: len(s["rr"])] = s["rr"] / s["rr"][0] if s["rr"][0] else math.nan
        return solve(rho)

    return per_subject(info, by_blocks(values, info, lags, sums), solved, names).withColumnRenamed("s", subject)


def _durbin_levinson(rho: np.ndarray) -> list[float]:
    out, phi = [], np.zeros(0)
    for k in range(1, len(rho)):
        top = rho[k] - phi @ rho[1:k][::-1]
        bottom = 1 - phi @ rho[1:k]
        last = top / bottom if bottom else math.nan
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return out


def pacf_per_subject(df: DataFrame, subject: str, time: str, value: str, lags: int = 3, least: int = 10) -> DataFrame:
    """Partial autocorrelations by Durbin-Levinson."""
    return autocorrelations(df, subject, time, value, lags, least, _durbin_levinson, [f"pacf{k}" for k in range(1, lags + 1)])


def acf_columns(df: DataFrame, subject: str, time: str, value: str, lags: int = 3) -> DataFrame:
    """(subject, n, acf1..): autocorrelations; those of lags that the series doesn't reach are NULL."""
    return autocorrelations(df, subject, time, value, lags, 1, lambda rho: list(rho[1:]), [f"acf{k}" for k in range(1, lags + 1)])


def long_lags(n: int, most: int) -> int:
    """Lags of the autoregression whose residuals stand for the shocks: the square root of the length, from some 200 values
    on Schwert's bound."""
    return min(max(most + 2, min(int(n**0.5), schwert(n))), n // 3)


def orders_per_subject(df: DataFrame, subject: str, time: str, value: str, least: int = 10, most: int = 3, criterion: str = "bic") -> DataFrame:
    """(subject, n, ar_order, ma_order): AR order by least squares; MA order by regressing on the residuals of a long autoregression
    (Hannan-Rissanen), each on a sample that all orders share."""
    return _orders_of(*numbered(df, subject, time, value, least), most, criterion).withColumnRenamed("s", subject)


def _orders_of(values: DataFrame, info: DataFrame, most: int = 3, criterion: str = "bic") -> DataFrame:
    def sums(info: dict, block: int, pos: np.ndarray, v: np.ndarray, own: int) -> Sums:
        reach = max(long_lags(int(info["n"]), most), most)
        return lagged("rr", v, v, own, reach) + ends(pos, v, own, int(info["n"]), reach)

    def score(gram: np.ndarray, rows: int) -> list[float]:
        """The criterion for 0 to most regressors; the target is the first row of gram."""
        out = []
        for k in range(most + 1):
            rss = fitted(gram[1 : k + 1, 1 : k + 1], gram[0, 1 : k + 1], gram[0, 0])[2] if k else gram[0, 0]
            out.append(rows * math.log(max(rss, 1e-300) / rows) + k * (math.log(rows) if criterion == "bic" else 2))
        return out

    def autoregressions(info: dict, s: dict[str, np.ndarray]) -> list[float]:
        n = int(info["n"])
        long = long_lags(n, most)
        values = score(cut_products(s["rr"], s["head"], s["tail"], most, most), n - most)
        gram = cut_products(s["rr"], s["head"], s["tail"], long, long)
        weights = fitted(gram[1:, 1:], gram[0, 1:], gram[0, 0])[0]
        return [float(np.argmin(values)), *weights, *[0.0] * (reach - long)]

    reach = largest(info, lambda n: long_lags(n, most)) if info.take(1) else 0
    names = [f"w{k}" for k in range(reach)]
    solved = per_subject(info, by_blocks(values, info, max(reach, most), sums), autoregressions, ["ar_order", *names])
    known = materialize(info.join(solved.select("s", "ar_order", F.array(*names).alias("weights")), "s"))

    def shocks(info: dict, block: int, pos: np.ndarray, v: np.ndarray, own: int) -> Sums:
        long = long_lags(int(info["n"]), most)
        weights = np.asarray(info["weights"], float)[:long]
        u = np.zeros(len(v))
        if len(v) > long:
            ahead = np.lib.stride_tricks.sliding_window_view(v, long)[:-1] if long else np.zeros((len(v), 0))
            u[long:] = v[long:] - ahead @ weights[::-1]
        at = np.flatnonzero(pos[own:] >= long + most) + own
        table = np.stack([v[at], *[u[at - k] for k in range(1, most + 1)]])
        return [("gram", i * (most + 1) + j, x) for (i, j), x in np.ndenumerate(table @ table.T)]

    def moving(info: dict, s: dict[str, np.ndarray]) -> tuple[float, float]:
        n = int(info["n"])
        rows = n - long_lags(n, most) - most
        if rows < most + 2:
            return info["ar_order"], 0.0
        return info["ar_order"], float(np.argmin(score(s["gram"].reshape(most + 1, -1), rows)))

    return per_subject(known, by_blocks(values, known, reach + most, shocks), moving, ["ar_order", "ma_order"])


def tests_of_columns(real: DataFrame, synthetic: DataFrame, subject: str, time: str, columns: Sequence[str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """`adf`, `kpss` and `orders` of every column's series, of the real and the synthetic subjects, with the column as `variable`. The series of all
    columns and both sides are those of one table, placed once, so jobs don't grow with the columns."""
    sides = []
    for k, df in enumerate((real, synthetic)):
        own = df.select(F.col(subject).cast("string").alias("id"), F.col(time).alias("time"), *[F.col(f"`{c}`").cast("double").alias(str(no)) for no, c in enumerate(columns)])
        long = own.unpivot(["id", "time"], [str(no) for no in range(len(columns))], "no", "value")
        sides.append(long.select(F.concat(F.lit(f"{k}|"), "no", F.lit("|"), "id").alias("series"), "time", "value"))
    values, info = numbered(sides[0].unionByName(sides[1]), "series", "time", "value", 3)
    names, part = F.array(*[F.lit(c) for c in columns]), F.split("s", r"\|", 3)

    def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = materialize(found).withColumn("variable", F.get(names, F.get(part, F.lit(1)).cast("int")))
        one, other = (named.where(F.get(part, F.lit(0)) == str(k)).drop("s") for k in range(2))
        return one, other

    return {"adf": split(_adf_of(values, info.where("n >= 8"))), "kpss": split(_kpss_of(values, info)), "orders": split(_orders_of(values, info.where("n >= 10")))}


def mean_series(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.groupBy(time).agg(F.avg(value).alias(value))


def _both(real: DataFrame, synthetic: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of both sides side by side: those of the same `by`, or the one row of each."""
    return real.join(F.broadcast(synthetic), list(by)) if by else real.crossJoin(F.broadcast(synthetic))


def compare_stationarity(real: DataFrame, synthetic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per value of `by` that both have: shares of stationary series and the verdict."""
    share = lambda t, n: t.groupBy(*by).agg((F.count_if(F.col("stationary")) * 100.0 / F.count("*")).alias(n))
    both = _both(share(real, "real"), share(synthetic, "synthetic"), by)
    verdict = (
        F.when((F.col("real") < 50) & (F.col("synthetic") >= 50), "fail")
        .when(F.abs(F.col("real") - F.col("synthetic")) < 20, "pass")
        .otherwise("warning")
    )
    return both.withColumn("verdict", verdict)


def compare_orders(real: DataFrame, synthetic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per value of `by` that both have: modal orders of both sides and the verdict."""
    modes = lambda t, n: t.groupBy(*by).agg(F.mode("ar_order", True).alias(f"{n}_ar"), F.mode("ma_order", True).alias(f"{n}_ma"))
    both = _both(modes(real, "real"), modes(synthetic, "synthetic"), by)
    same = [(F.col(f"real_{k}") == F.col(f"synthetic_{k}")).cast("int") for k in ("ar", "ma")]
    n = same[0] + same[1]
    return both.withColumn("verdict", F.when(n == 2, "pass").when(n == 1, "warning").otherwise("fail"))


def compare_acf(real: DataFrame, synthetic: DataFrame, lags: int = 3) -> DataFrame:
    """One row: mean squared difference and correlation of mean autocorrelations, and the verdict."""
    mean = lambda t, n: t.agg(F.array(*[F.avg(f"acf{k}") for k in range(1, lags + 1)]).alias(n))
    both = mean(real, "a").crossJoin(F.broadcast(mean(synthetic, "b")))
    pairs = both.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select("z.a", "z.b")
    out = pairs.agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"), F.corr("a", "b").alias("r"))
    return out.withColumn("passed", (F.col("mse") < 0.05) & (F.col("r") > 0.7))
