"""Scoring a fitted disease-course model: closed formulas over saved parameters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.scalars import reparametrized_time
from visitframe.operators.stats import ks_p_value, ks_statistic
from visitframe.session import materialize


def logistic_course(t: Column, xi: Column, tau: Column, g: float, v0: float, shift: Column | None = None, tau_mean: float = 0.0) -> Column:
    """A feature's value at age t for a subject: 1 / (1 + g exp(-b (psi - t0) - w)) with
    b = v0 (1 + g)^2 / g, psi the subject's own time and w the space shift."""
    psi = reparametrized_time(t, xi, tau, F.lit(0.0))
    slope = v0 * (1 + g) ** 2 / g
    moved = F.lit(slope) * psi + (shift if shift is not None else F.lit(0.0))
    return 1 / (1 + F.lit(g) * F.exp(-moved))


def score(df: DataFrame, time: str, xi: str, tau: str, features: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return df.withColumns({f: logistic_course(F.col(time), F.col(xi), F.col(tau), p["g"], p["v0"]) for f, p in features.items()})


def prediction_grid(df: DataFrame, subject: str, time: str, steps: int, width: float) -> DataFrame:
    """(subject, time): `steps` times from each subject's last visit on."""
    last = df.groupBy(subject).agg(F.max(time).cast("double").alias("__last"))
    return last.select(subject, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("__k"), "__last").select(
        subject, (F.col("__last") + F.col("__k") * F.lit(width)).alias(time)
    )


def age_bounds(df: DataFrame, time: str, xi: str, tau: str) -> DataFrame:
    """One row: 1st percentile of the reparametrised time, rounded down less 5, and 99th, rounded up
    plus 5."""
    mean = df.agg(F.avg(tau).alias("__m"))
    psi = reparametrized_time(F.col(time), F.col(xi), F.col(tau), F.col("__m"))
    p = F.percentile(psi, [0.01, 0.99])
    return df.crossJoin(F.broadcast(mean)).agg(p.alias("p")).select(
        (F.floor(F.get("p", F.lit(0))) - 5).alias("low"), (F.ceil(F.get("p", F.lit(1))) + 5).alias("high")
    )


def individual_parameters(
    df: DataFrame, subject: str, time: str, features: Mapping[str, Mapping[str, float]], tau_mean: float, tau_std: float, xi_std: float = 0.5,
    noise: float = 0.1, rounds: int = 40, tolerance: float = 1e-6,
) -> DataFrame:
    """(subject, n, xi, tau, cost, converged): each subject's log-acceleration and onset, the most likely ones given its values
    and normal priors (means 0 and tau_mean), by Gauss-Newton steps with Levenberg's damping. A round is one join of the values with
    the subjects' current parameters and one aggregate to seven sums a subject, combined before they move; the steps are columns. So no
    subject is gathered, whatever its visits. Values and times that are null or not numbers count for nothing, subjects without any value
    are left out, and `converged` tells whose last step was below `tolerance` (of tau in units of tau_std)."""
    t = F.col(time).cast("double")
    values = F.array(*[F.struct(F.lit(float(p["g"])).alias("g"), F.lit(p["v0"] * (1 + p["g"]) ** 2 / p["g"]).alias("b"), F.col(f"`{f}`").cast("double").alias("y")) for f, p in features.items()])
    long = df.where(F.col(subject).isNotNull() & t.isNotNull() & ~F.isnan(t)).select(F.col(subject).alias("s"), t.alias("t"), F.explode(values).alias("z"))
    long = materialize(long.select("s", "t", "z.*").where("y is not null and not isnan(y)"))

    def sums(state: DataFrame) -> DataFrame:
        """Cost, gradient and curvature at (try_xi, try_u), where u = (tau - tau_mean) / tau_std."""
        both = long.join(state.select("s", "try_xi", "try_u"), "s")
        speed = F.exp("try_xi")
        moved = F.col("b") * speed * (F.col("t") - (F.col("try_u") * tau_std + tau_mean))
        both = both.withColumn("m", moved).withColumn("eta", 1 / (1 + F.col("g") * F.exp(-F.col("m"))))
        off, slope = (F.col("y") - F.col("eta")) / noise, F.col("eta") * (1 - F.col("eta")) / noise
        j1, j2 = slope * F.col("m"), -slope * F.col("b") * speed * tau_std
        own = both.select("s", off.alias("r"), j1.alias("j1"), j2.alias("j2")).groupBy("s").agg(
            F.sum(F.col("r") ** 2).alias("rr"), F.sum(F.col("j1") * F.col("r")).alias("g1"), F.sum(F.col("j2") * F.col("r")).alias("g2"),
            F.sum(F.col("j1") ** 2).alias("h11"), F.sum(F.col("j1") * F.col("j2")).alias("h12"), F.sum(F.col("j2") ** 2).alias("h22"),
        )
        weight = 1 / xi_std**2
        return state.join(own, "s").withColumns({
            "rr": F.col("rr") + F.col("try_xi") ** 2 * weight + F.col("try_u") ** 2, "g1": F.col("g1") - F.col("try_xi") * weight, "g2": F.col("g2") - F.col("try_u"),
            "h11": F.col("h11") + weight, "h22": F.col("h22") + 1,
        })

    sizes = long.groupBy("s").agg(F.count("*").alias("n"))
    state = sizes.select("s", "n", *[F.lit(v).alias(c) for c, v in (("try_xi", 0.0), ("try_u", 0.0), ("xi", 0.0), ("u", 0.0), ("cost", math.inf), ("damping", 1e-2))])
    state = state.select("*", *[F.lit(0.0).alias(f"o_{c}") for c in ("g1", "g2", "h11", "h12", "h22")], F.lit(False).alias("converged"))
    for _ in range(rounds):
        tried = sums(state)
        better = F.col("rr") <= F.col("cost")
        kept = {c: F.when(better, F.col(f"try_{c}")).otherwise(F.col(c)) for c in ("xi", "u")}
        kept |= {f"o_{c}": F.when(better, F.col(c)).otherwise(F.col(f"o_{c}")) for c in ("g1", "g2", "h11", "h12", "h22")}
        kept |= {"cost": F.least("rr", "cost"), "damping": F.when(better, F.col("damping") / 5).otherwise(F.col("damping") * 4)}
        own = tried.select("s", "n", "converged", *[v.alias(c) for c, v in kept.items()])
        a, d = F.col("o_h11") * (1 + F.col("damping")), F.col("o_h22") * (1 + F.col("damping"))
        det = a * d - F.col("o_h12") ** 2
        step1, step2 = (d * F.col("o_g1") - F.col("o_h12") * F.col("o_g2")) / det, (a * F.col("o_g2") - F.col("o_h12") * F.col("o_g1")) / det
        # steps are cut where the model is far from linear
        cut = F.least(F.lit(1.0), 1 / F.greatest(F.abs(step1), F.abs(step2) / 2, F.lit(1e-12)))
        own = own.withColumns({"try_xi": F.col("xi") + step1 * cut, "try_u": F.col("u") + step2 * cut})
        state = materialize(own.withColumn("converged", F.greatest(F.abs(step1), F.abs(step2)) < tolerance))
        if state.where("not converged").isEmpty():
            break
    return state.select(F.col("s").alias(subject), "n", "xi", (F.col("u") * tau_std + tau_mean).alias("tau"), "cost", "converged")


def compare_parameters(real: DataFrame, synthetic: DataFrame, names: Sequence[str] = ("xi", "tau")) -> DataFrame:
    """(variable, statistic, p_value, means and deviations of both sides, passed): Kolmogorov-Smirnov per individual parameter."""
    gaps = ks_statistic(real, synthetic, names)
    gaps = gaps.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_real"), F.col("n_synthetic")))
    for side, df in (("real", real), ("synthetic", synthetic)):
        long = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "variable", "v")
        gaps = gaps.join(long.groupBy("variable").agg(F.avg("v").alias(f"mean_{side}"), F.stddev_pop("v").alias(f"std_{side}")), "variable")
    return gaps.withColumn("passed", F.col("p_value") > 0.05)


def population_curve(features: Mapping[str, Mapping[str, float]], times: Sequence[float], tau: float) -> dict[str, list[float]]:
    """Values of the population's own curve, on the driver: as many as times."""
    out = {}
    for f, p in features.items():
        b = p["v0"] * (1 + p["g"]) ** 2 / p["g"]
        out[f] = [1 / (1 + p["g"] * math.exp(-b * (t - tau))) for t in times]
    return out
