"""Holt's linear trend with a grid fit, prediction intervals, and a walk-forward backtest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.functions.stats import t_quantile

GRID = np.linspace(0.02, 0.98, 21)
LEAST_PERIODS, ADVISED_PERIODS = 8, 12


def _smooth(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend and squared errors so far after every value, for all weights of the grid side by side: (values, weights).

    The first two values start level and trend.  One run serves every beginning of the series.
    """
    alpha, beta = (g.ravel() for g in np.meshgrid(GRID, GRID, indexing="ij"))
    level, trend, sse = (np.zeros((len(x), len(alpha))) for _ in range(3))
    level[0], trend[0] = x[0], x[1] - x[0]
    for i in range(1, len(x)):
        ahead = level[i - 1] + trend[i - 1]
        level[i] = alpha * x[i] + (1 - alpha) * ahead
        trend[i] = beta * (level[i] - level[i - 1]) + (1 - beta) * trend[i - 1]
        sse[i] = sse[i - 1] + (x[i] - ahead) ** 2
    return level, trend, sse


def _best(sse: np.ndarray) -> int:
    """The first weights whose error is not beaten by more than rounding."""
    return int(np.flatnonzero(sse <= sse.min() + 1e-12)[0])


def fit(series: np.ndarray) -> dict | None:
    """Level and trend after the last value, the two smoothing weights of least squared error, and the error's sd.
    None below four values."""
    x = np.asarray(series, float)
    if len(x) < 4:
        return None
    level, trend, sse = _smooth(x)
    best = _best(sse[-1])
    errors = x[1:] - level[:-1, best] - trend[:-1, best]
    return {"alpha": float(GRID[best // len(GRID)]), "beta": float(GRID[best % len(GRID)]), "level": float(level[-1, best]), "trend": float(trend[-1, best]), "sigma": float(errors.std(ddof=1)), "n": len(x)}


def forecast(model: dict, horizon: int, confidence: float = 0.8) -> list[dict]:
    """(step, value, low, high); the interval widens with the horizon."""
    t = t_quantile(0.5 + confidence / 2, max(2, model["n"] - 2))
    out, spread = [], 0.0
    for k in range(1, horizon + 1):
        spread += (1 + (k - 1) * model["alpha"] * model["beta"]) ** 2
        value, half = model["level"] + k * model["trend"], t * model["sigma"] * math.sqrt(spread)
        out.append({"step": k, "value": value, "low": value - half, "high": value + half})
    return out


def backtest(series: np.ndarray, least: int = 6) -> dict | None:
    """One-step forecasts from growing histories: folds, mean absolute error of model and of the naive last value, and
    their ratio on the same folds (naive_ratio below 1: the model helps)."""
    x = np.asarray(series, float)
    if len(x) < least + 2:
        return None
    level, trend, sse = _smooth(x)
    errors = []
    for i in range(max(4, least), len(x)):
        best = _best(sse[i - 1])  # fitted to the values before i alone
        errors.append((abs(level[i - 1, best] + trend[i - 1, best] - x[i]), abs(x[i - 1] - x[i])))
    if not errors or not sum(e[1] for e in errors):
        return None
    model, naive = (float(np.mean([e[k] for e in errors])) for k in (0, 1))
    return {"folds": len(errors), "mae": model, "naive_mae": naive, "naive_ratio": model / naive}


def forecast_series(series: DataFrame, horizon: int = 3, key: str = "series", confidence: float = 0.8) -> DataFrame:
    """(key, period, value) -> (key, step, value, low, high, naive_ratio, folds), each series in one task.

    A series of fewer than LEAST_PERIODS observed periods gives no rows.  Series are periods of cells, not rows, so one
    series is short whatever the input.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("period")["value"].dropna().to_numpy(float)
        rows = []
        if len(x) >= LEAST_PERIODS and (m := fit(x)):
            b = backtest(x, max(6, len(x) // 2)) or {"naive_ratio": None, "folds": 0}
            rows = [{key: pdf[key].iloc[0], **f, "naive_ratio": b["naive_ratio"], "folds": b["folds"]} for f in forecast(m, horizon, confidence)]
        return pd.DataFrame(rows, columns=[key, "step", "value", "low", "high", "naive_ratio", "folds"])

    return series.select(key, "period", "value").groupBy(key).applyInPandas(run, f"{key} string, step int, value double, low double, high double, naive_ratio double, folds int")
