"""Statistics of short lists on the driver: series of a few dozen periods, members of one dimension."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import fmean, stdev

import numpy as np


def quantile(xs: Sequence[float], p: float) -> float:
    """Type-7 quantile; NaN of nothing."""
    return float(np.quantile(np.asarray(xs, float), p)) if len(xs) else math.nan


def median(xs: Sequence[float]) -> float:
    return quantile(xs, 0.5)


def mad(xs: Sequence[float]) -> float:
    """Median absolute deviation, scaled to the sd of a normal."""
    m = median(xs)
    return 1.4826 * median([abs(x - m) for x in xs])


def robust_z(xs: Sequence[float]) -> tuple[list[float], str]:
    """Deviations from the median in MADs, or from the mean in sds where the MAD is zero; and which."""
    spread, centre, basis = mad(xs), median(xs), "mad"
    if not spread > 0:
        spread, centre, basis = (stdev(xs) if len(xs) > 1 else 0.0), fmean(xs) if len(xs) else 0.0, "sd"
    return [(x - centre) / spread if spread > 0 else 0.0 for x in xs], basis


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the even form of the continued fraction, evaluated from its tail."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    f = 1.0
    for k in range(400, 0, -1):
        m = k // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = 1 + d / f
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / (a * f)


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t; infinite t: 0."""
    return 0.0 if not math.isfinite(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t for many (t, df) at once, NaN without degrees of freedom: the continued fraction of the
    incomplete beta function in even and odd steps, until no value moves any more."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.where(df > 0, np.where(t == 0, 1.0, 0.0), np.nan)
    use = (df > 0) & np.isfinite(t) & (t != 0)
    square, n = t[use] ** 2, df[use]
    far = n / (n + square) < (n / 2 + 1) / (n / 2 + 2.5)
    a, b = np.where(far, n / 2, 0.5), np.where(far, 0.5, n / 2)
    x, y = np.where(far, n / (n + square), square / (n + square)), np.where(far, square / (n + square), n / (n + square))
    gamma = np.vectorize(math.lgamma, otypes=[float])
    if len(n):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log(y)) / a
        guard = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
        high, low, value = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1)), 1 / guard(1 - (a + b) * x / (a + 1))
        for m in range(1, 400):
            step = np.ones_like(x)
            for d in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                low, high = 1 / guard(1 + d * low), guard(1 + d / high)
                step *= low * high
            value *= step
            if np.abs(step - 1).max() < 1e-14:
                break
        part = np.minimum(1.0, front * value)
        out[use] = np.where(far, part, 1 - part)
    return out


def t_cdf(t: float, df: float) -> float:
    return 1 - t_p(t, df) / 2 if t > 0 else t_p(t, df) / 2


def t_quantile(p: float, df: float) -> float:
    """Inverse of t_cdf, by bisection."""
    low, high = -1000.0, 1000.0
    while high - low > 1e-12 * max(1.0, abs(low)):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def mean_interval(xs: Sequence[float], confidence: float = 0.95) -> tuple[float, float, float] | None:
    """(mean, low, high); None for fewer than two values."""
    if len(xs) < 2:
        return None
    m, half = fmean(xs), t_quantile(0.5 + confidence / 2, len(xs) - 1) * stdev(xs) / math.sqrt(len(xs))
    return m, m - half, m + half


def cohens_d(value: float, others: Sequence[float]) -> float | None:
    """Distance from the mean of the others in their sds; None if they do not vary."""
    sd = stdev(others) if len(others) > 1 else 0.0
    return (value - fmean(others)) / sd if sd > 0 else None


def pearson(xs: Sequence[float], ys: Sequence[float]) -> float | None:
    if len(xs) < 3 or np.std(xs) == 0 or np.std(ys) == 0:
        return None
    return float(np.corrcoef(xs, ys)[0, 1])


def ranks(xs: Sequence[float]) -> np.ndarray:
    """Average ranks."""
    x = np.asarray(xs, float)
    _, which, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[which]


def spearman(xs: Sequence[float], ys: Sequence[float]) -> float | None:
    return pearson(ranks(xs), ranks(ys))


def benjamini_hochberg(ps: Sequence[float]) -> list[float]:
    """q-values in the order of the p-values."""
    p = np.asarray(ps, float)
    if not len(p):
        return []
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out.tolist()


def format_p(p: float | None, name: str = "p") -> str:
    if p is None:
        return "not tested"
    return f"{name} < 1e-6" if p < 1e-6 else f"{name} = {p:.1e}" if p < 1e-3 else f"{name} = {p:.3f}"
