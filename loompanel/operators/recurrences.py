"""Exponential recurrences (EMA, Wilder) as window sums.

``y[t] = q y[t-1] + b[t]`` is cut into blocks of so many rows that q^rows is about 1e-8.  Inside a block
``y`` is q^k times a running sum of b / q^k; across blocks only the ends of the two blocks before matter.
All of it runs over windows of one ticker order: no row-by-row pass, no group held in memory.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.functions.columns import P, at_least, lag, rolling, td, trailing
from loompanel.operators.features import add_if_missing, true_range


def affine_scan(df: DataFrame, name: str, value: Column, alpha: float, seed: int, seed_value: Column | None = None, start: int = 1) -> DataFrame:
    """Adds ``name``: null before row ``seed`` (counted from 1), there the seed value (the value itself if
    not given), then ``alpha value + (1 - alpha)`` times the row before.

    ``seed_value`` is a window expression evaluated on the seed row.  Rows must hold known values from
    ``start`` on.
    """
    q = 1.0 - alpha
    rows = max(2, ceil(log(1e-8) / log(q)))
    out = df.withColumn("__n", F.row_number().over(P()) - seed)
    first = seed_value if seed_value is not None else value
    b = F.when(F.col("__n") == 0, first).when(F.col("__n") > 0, value * alpha)
    out = out.withColumns({"__b": b, "__k": F.pmod("__n", F.lit(rows)), "__block": F.floor(F.col("__n") / rows)})
    inside = W.partitionBy("tic", "__block").orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("__local", F.when(F.col("__n") >= 0, F.pow(F.lit(q), F.col("__k")) * F.sum(F.col("__b") * F.pow(F.lit(q), -F.col("__k").cast("double"))).over(inside)))
    by_block = W.partitionBy("tic").orderBy("__block")
    end = lambda d: F.coalesce(F.max_by("__local", "__n").over(by_block.rangeBetween(-d, -d)), F.lit(0.0))
    carried = end(1) + end(2) * q**rows
    out = out.withColumn(name, F.when(F.col("__n") >= 0, F.col("__local") + F.pow(F.lit(q), F.col("__k") + 1) * carried))
    return out.drop("__n", "__b", "__k", "__block", "__local")


def ema_first(df: DataFrame, name: str, column: str, span: int) -> DataFrame:
    """Seeded by the first value."""
    return affine_scan(df, name, F.col(column), 2.0 / (span + 1), 1)


def ema(df: DataFrame, p: int, column: str = "close", name: str | None = None, seed: int | None = None) -> DataFrame:
    """Seeded by the mean of p values at row ``seed`` (p if not given); null before."""
    s = seed or p
    return affine_scan(df, name or f"ema_{p}", F.col(column), 2.0 / (p + 1), s, F.avg(column).over(trailing(p)))


def rsi(df: DataFrame, p: int = 7, name: str | None = None) -> DataFrame:
    """Wilder's relative strength index as a share; seeded by the mean of the first p changes."""
    change = F.col("close") - lag("close")
    out = df.withColumns({"__up": F.greatest(change, F.lit(0.0)), "__down": F.greatest(-change, F.lit(0.0))})
    for c in ("__up", "__down"):
        out = affine_scan(out, f"{c}_avg", F.col(c), 1.0 / p, p + 1, F.avg(c).over(trailing(p)))
    total = F.col("__up_avg") + F.col("__down_avg")
    value = F.when(total.isNotNull(), F.coalesce(td(F.col("__up_avg"), F.nullif(total, F.lit(0.0))), F.lit(0.0)))
    return out.withColumn(name or f"rsi_{p}", value).drop("__up", "__down", "__up_avg", "__down_avg")


def stoch_rsi(df: DataFrame, p: int = 7, k: int = 14, d: int = 3) -> DataFrame:
    """Place of the index in its range of k bars; the d-bar smoothing only lengthens the warm-up."""
    out = rsi(df, p, "__rsi")
    low, high = rolling(F.min, "__rsi", k), rolling(F.max, "__rsi", k)
    place = F.coalesce(td(F.col("__rsi") - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))
    return out.withColumn(f"stochrsi_{p}", at_least(place, "__rsi", k + d - 1, k + d - 1)).drop("__rsi")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Both averages start at row ``slow``; all three columns at row slow + signal - 1."""
    out = ema(ema(df, fast, name="__fast", seed=slow), slow, name="__slow").withColumn("__macd", F.col("__fast") - F.col("__slow"))
    start = slow + signal - 1
    out = affine_scan(out, "macd_signal", F.col("__macd"), 2.0 / (signal + 1), start, F.avg("__macd").over(trailing(signal)))
    shown = F.col("macd_signal").isNotNull()
    return out.withColumns({"macd": F.when(shown, F.col("__macd")), "macd_hist": F.col("__macd") - F.col("macd_signal")}).drop("__fast", "__slow", "__macd")


def atr_norm(df: DataFrame, p: int = 14) -> DataFrame:
    """Wilder's average true range over the close; the first bar has no true range."""
    out = df.withColumn("__tr", F.when(lag("close").isNotNull(), true_range()))
    out = affine_scan(out, "__atr", F.col("__tr"), 1.0 / p, p + 1, F.avg("__tr").over(trailing(p)))
    return out.withColumn(f"atr_{p}_norm", td(F.col("__atr"), F.nullif(F.col("close"), F.lit(0.0)))).drop("__tr", "__atr")


def smoothed_bodies(df: DataFrame) -> DataFrame:
    """body_size_ema_5 and body_size_ema_20, seeded by the first body.  Needs candle_shape."""
    out = ema_first(ema_first(df, "__e5", "body_size", 5), "__e20", "body_size", 20)
    return add_if_missing(out, {"body_size_ema_5": F.col("__e5"), "body_size_ema_20": F.col("__e20")}).drop("__e5", "__e20")


def technical(df: DataFrame, emas: tuple[int, ...] = (50, 200), rsi_period: int = 7) -> DataFrame:
    for p in emas:
        df = ema(df, p)
    return atr_norm(macd(stoch_rsi(rsi(df, rsi_period), rsi_period)))
