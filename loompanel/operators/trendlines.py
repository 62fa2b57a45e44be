"""Support and resistance lines that touch a window of bars and do not cross it by more than a tolerance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loompanel.functions.columns import nn, trailing


def fit_lines(y: np.ndarray, pivot: np.ndarray, slope: np.ndarray, above: bool, tolerance: float, rounds: int) -> np.ndarray:
    """For each row of y the slope through its pivot with least squared distance among those that a halving
    step search meets.  ``above``: the line lies above the points (resistance), else below them (support).
    All rows take their step at once.
    """
    n, w = y.shape
    x = np.arange(w) - pivot[:, None]
    at = y[np.arange(n), pivot][:, None]

    def error(s: np.ndarray) -> np.ndarray:
        gap = s[:, None] * x + at - y
        crossed = gap.min(axis=1) < -tolerance if above else gap.max(axis=1) > tolerance
        return np.where(crossed, np.inf, (gap * gap).sum(axis=1))

    best = error(slope)
    flat = ~np.isfinite(best)
    slope = np.where(flat, 0.0, slope)
    best = np.where(flat, error(slope), best)
    step = np.maximum(np.maximum(np.ptp(y, axis=1), tolerance) / max(w - 1, 1), tolerance)
    for _ in range(rounds):
        moving = step > tolerance
        if not moving.any():
            break
        down, up = error(slope - step), error(slope + step)
        tried = np.minimum(down, up)
        better = moving & np.isfinite(tried) & (tried <= best)
        slope = np.where(better, np.where(down <= up, slope - step, slope + step), slope)
        best = np.where(better, tried, best)
        step = np.where(moving & ~better, step / 2, step)
    return slope


def trendlines(df: DataFrame, window: int = 30, tolerance: float = 1e-4, rounds: int = 40) -> DataFrame:
    """opt_slope_sup, opt_slope_res and the width between the lines at the window's end.

    Each row carries its window of closes, lows and highs as arrays, so rows are solved in any task, a
    batch at once."""
    w = trailing(window)
    rows = df.withColumns({f"__{c}": F.collect_list(c).over(w) for c in ("close", "low", "high")})

    def solve(close: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        out = np.full((len(close), 3), np.nan)
        whole = np.flatnonzero((close.str.len() == window) & (low.str.len() == window) & (high.str.len() == window))
        if len(whole):
            c, a, b = (np.stack(s.iloc[whole].to_numpy()).astype(np.float64) for s in (close, low, high))
            x = np.arange(window) - (window - 1) / 2
            slope = (c @ x) / (x @ x)
            line = c.mean(axis=1)[:, None] + slope[:, None] * x
            bottom, top = (a - line).argmin(axis=1), (b - line).argmax(axis=1)
            i = np.arange(len(whole))
            s, r = fit_lines(a, bottom, slope, False, tolerance, rounds), fit_lines(b, top, slope, True, tolerance, rounds)
            out[whole] = np.column_stack([s, r, r * (window - 1 - top) + b[i, top] - s * (window - 1 - bottom) - a[i, bottom]])
        return pd.DataFrame(out, columns=["s", "r", "w"])

    solved = rows.withColumn("__t", F.pandas_udf(solve, "struct<s:double,r:double,w:double>")("__close", "__low", "__high"))
    names = {f"opt_slope_sup_{window}": "s", f"opt_slope_res_{window}": "r", f"opt_channel_width_{window}": "w"}
    return solved.withColumns({k: nn(F.col(f"__t.{v}")) for k, v in names.items()}).drop("__t", "__close", "__low", "__high")
