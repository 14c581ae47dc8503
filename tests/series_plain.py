"""Tests of one series held in memory, by their textbook formulas: what the block-wise operators are held against."""

from __future__ import annotations

import math

import numpy as np

from visitframe.operators.timeseries import KPSS_P, KPSS_VALUES, dickey_fuller_p


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    r = y - x @ beta
    return beta, inverse, float(r @ r)


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """Statistic, p-value and lags of the augmented Dickey-Fuller test with a constant; lags by AIC."""
    n = len(y)
    d = np.diff(y)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        columns = [y[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))]
        return np.stack(columns, axis=1), d[rows]

    best, chosen = math.inf, 0
    for lags in range(most + 1):
        x, z = design(lags, most)
        if len(z) <= x.shape[1]:
            break
        _, _, rss = _ols(x, z)
        aic = len(z) * (math.log(max(rss, 1e-300) / len(z)) + math.log(2 * math.pi) + 1) + 2 * x.shape[1]
        if aic < best - 1e-12:
            best, chosen = aic, lags
    x, z = design(chosen, chosen)
    beta, inverse, rss = _ols(x, z)
    free = len(z) - x.shape[1]
    if free <= 0 or rss <= 0:
        return math.nan, math.nan, chosen
    t = beta[0] / math.sqrt(rss / free * inverse[0, 0])
    return t, dickey_fuller_p(t), chosen


def kpss(y: np.ndarray) -> tuple[float, float, int]:
    """Statistic, p-value (between 0.01 and 0.1) and lags of the KPSS test for a level."""
    n = len(y)
    r = y - y.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = float(r @ r) / n, 0.0
    for i in range(1, cov + 1):
        product = float(r[i:] @ r[: n - i]) / (n / 2)
        s0, s1 = s0 + product, s1 + i * product
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    long_run = float(r @ r)
    for i in range(1, lags + 1):
        long_run += 2 * float(r[i:] @ r[: n - i]) * (1 - i / (lags + 1))
    if long_run <= 0:
        return math.nan, math.nan, lags
    stat = float((np.cumsum(r) ** 2).sum()) / n**2 / (long_run / n)
    return stat, float(np.interp(stat, KPSS_VALUES, KPSS_P)), lags


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    r = y - y.mean()
    total = float(r @ r)
    return np.array([float(r[k:] @ r[: len(r) - k]) / total if total else math.nan for k in range(lags + 1)])


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations by Durbin-Levinson."""
    rho, out, phi = acf(y, lags), [1.0], np.zeros(0)
    for k in range(1, lags + 1):
        top = rho[k] - phi @ rho[1:k][::-1]
        bottom = 1 - phi @ rho[1:k]
        last = top / bottom if bottom else math.nan
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.array(out)


def orders(y: np.ndarray, most: int = 3, criterion: str = "bic") -> tuple[int, int]:
    """AR order by least squares; MA order by regressing on the residuals of a long autoregression
    (Hannan-Rissanen), both on a common sample."""
    n = len(y)
    r = y - y.mean()
    long = min(max(most + 2, int(n**0.5)), n // 3)

    def lagged(s: np.ndarray, k: int, start: int) -> np.ndarray:
        return np.stack([s[start - j : n - j] for j in range(1, k + 1)] or [np.zeros(n - start)], axis=1)

    def info(x: np.ndarray, z: np.ndarray, k: int) -> float:
        rss = _ols(x, z)[2] if k else float(z @ z)
        penalty = k * (math.log(len(z)) if criterion == "bic" else 2)
        return len(z) * math.log(max(rss, 1e-300) / len(z)) + penalty

    ar = min(range(most + 1), key=lambda k: info(lagged(r, k, most), r[most:], k))
    x = lagged(r, long, long)
    shock = np.concatenate([np.zeros(long), r[long:] - x @ _ols(x, r[long:])[0]])
    start = long + most
    if n - start < most + 2:
        return ar, 0
    return ar, min(range(most + 1), key=lambda k: info(lagged(shock, k, start), r[start:], k))
