"""Feature families of a bar panel (tic, date, open, high, low, close, volume): column expressions over
windows of one specification, so that a family costs one shuffle by ticker and one sort.

Each function adds columns to the panel.  Candle and structure columns fill unknown values with 0 and
never replace columns that are there; the other families leave unknown values null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.functions.columns import P, add_if_missing, extremes, filled, flag, lag, pct, rolling, td, trailing, zero, zscore
from loompanel.operators.analyse import ohlcv_contract

TINY = 1e-8


def calendar(df: DataFrame) -> DataFrame:
    """day 1-31, month 1-12, dayofweek with Monday 0."""
    return df.withColumns({"day": F.dayofmonth("date"), "month": F.month("date"), "dayofweek": F.weekday("date")})


def stamps(df: DataFrame, column: str = "date") -> DataFrame:
    """minute, hour, weekday, day and month of every timestamp of an array column, as arrays."""
    parts = {"minute": F.minute, "hour": F.hour, "weekday": F.weekday, "day": F.dayofmonth, "month": F.month}
    return df.withColumns({f"{column}_{n}": F.transform(column, f) for n, f in parts.items()})


def roc(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn(f"roc_{n}", (td(F.col("close"), lag("close", n)) - 1) * 100)


def bollinger_width(df: DataFrame, n: int = 20) -> DataFrame:
    """Width of mean +- 2 population deviations over the mean."""
    return df.withColumn(f"bb_width_{n}", td(rolling(F.stddev_pop, "close", n) * 4, rolling(F.avg, "close", n)))


def channel(df: DataFrame, n: int = 20) -> DataFrame:
    """Slopes of support and resistance, compression of and place in the channel of n bars."""
    low, high = rolling(F.min, "low", n), rolling(F.max, "high", n)
    following = P().rowsBetween(0, W.unboundedFollowing)
    out = df.withColumns({"__low": low, "__high": high, "__pos": F.row_number().over(P()).cast("double")})
    out = out.withColumns({"__sup": F.first("__low", ignorenulls=True).over(following), "__res": F.first("__high", ignorenulls=True).over(following)})
    c, span = F.col("close"), F.greatest(F.col("__high") - F.col("__low"), F.lit(TINY))
    full = F.count("__sup").over(trailing(n)) >= n
    return out.withColumns(
        {
            f"slope_sup_{n}": F.when(full, F.regr_slope("__sup", "__pos").over(trailing(n))),
            f"slope_res_{n}": F.when(full, F.regr_slope("__res", "__pos").over(trailing(n))),
            f"channel_compression_{n}": td(F.col("__high") - F.col("__low"), F.greatest(F.abs(c), F.lit(TINY))),
            f"channel_position_{n}": F.when(F.col("__high").isNotNull(), td(c - F.col("__low"), span)),
        }
    ).drop("__low", "__high", "__sup", "__res", "__pos")


def swings(df: DataFrame, n: int = 20) -> DataFrame:
    """Distance to, and bars since, the highest high and the lowest low of n bars (the latest of equals)."""
    c = F.greatest(F.abs(F.col("close")), F.lit(TINY))
    out = df.withColumn("__pos", F.row_number().over(P()))
    w, full = trailing(n), F.count("high").over(trailing(n)) >= n
    return out.withColumns(
        {
            f"dist_to_swing_high_{n}": td(F.col("close") - rolling(F.max, "high", n), c),
            f"dist_to_swing_low_{n}": td(F.col("close") - rolling(F.min, "low", n), c),
            f"days_since_swing_high_{n}": F.when(full, F.col("__pos") - F.max_by("__pos", F.struct("high", "__pos")).over(w)),
            f"days_since_swing_low_{n}": F.when(full, F.col("__pos") - F.min_by("__pos", F.struct("low", -F.col("__pos"))).over(w)),
        }
    ).drop("__pos")


def fibonacci(df: DataFrame, n: int = 60) -> DataFrame:
    out = df.withColumns({"swing_high": rolling(F.max, "high", n), "swing_low": rolling(F.min, "low", n)}).withColumn("fib_range", F.col("swing_high") - F.col("swing_low"))
    levels = {"38": 0.382, "50": 0.5, "61": 0.618}
    out = out.withColumns({f"fib_{k}": F.col("swing_high") - F.col("fib_range") * v for k, v in levels.items()})
    far = {f"dist_fib_{k}": td(F.col("close") - F.col(f"fib_{k}"), F.nullif(F.col("fib_range"), F.lit(0.0))) for k in levels}
    return out.withColumns(far | {"break_fib_61": flag(F.col("close") < F.col("fib_61"))})


def _over(a: Column, b: Column) -> Column:
    """a / b, 0 where b is tiny or unknown."""
    return F.when(F.abs(b) > TINY, td(a, b))


def candle_shape(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, upper, lower, span = F.abs(c - o), F.greatest(h - F.greatest(o, c), F.lit(0.0)), F.greatest(F.least(o, c) - l, F.lit(0.0)), F.greatest(h - l, F.lit(0.0))
    made = {"body_size": body, "upper_shadow": upper, "lower_shadow": lower, "high_low_range": span}
    made |= {"body_ratio": _over(body, span), "upper_shadow_ratio": _over(upper, span), "lower_shadow_ratio": _over(lower, span), "close_position": _over(c - l, span), "open_position": _over(o - l, span)}
    return add_if_missing(df, {k: zero(v) for k, v in made.items()} | {"candle_direction": F.signum(c - o).cast("tinyint")})


def gaps(df: DataFrame) -> DataFrame:
    o, pc = F.col("open"), lag("close")
    return add_if_missing(df, {"gap_up": flag(o > lag("high")), "gap_down": flag(o < lag("low")), "gap_size": zero(o - pc), "overnight_return": zero(td(o - pc, pc))})


def shape_changes(df: DataFrame) -> DataFrame:
    """Needs candle_shape."""
    return add_if_missing(df, {f"{c}_change": zero(F.col(c) - lag(c)) for c in ("body_size", "upper_shadow", "lower_shadow")})


def true_range() -> Column:
    pc = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def ranges(df: DataFrame) -> DataFrame:
    """Simple average true range, and the ranges of 5 and 20 bars."""
    out = df.withColumn("__tr", true_range())
    mean = lambda n: zero(rolling(F.avg, "__tr", n, 1))
    spans = {f"rolling_high_low_range_{n}": zero(rolling(F.max, "high", n, 1) - rolling(F.min, "low", n, 1)) for n in (5, 20)}
    return add_if_missing(out, {"atr": mean(14), "atr_14": mean(14), "atr_20": mean(20)} | spans).drop("__tr")


def percent_sizes(df: DataFrame) -> DataFrame:
    """Needs candle_shape."""
    parts = {"body_size_pct": "body_size", "upper_shadow_pct": "upper_shadow", "lower_shadow_pct": "lower_shadow", "range_pct": "high_low_range"}
    return add_if_missing(df, {k: zero(_over(F.col(v), F.col("close"))) for k, v in parts.items()})


def returns(df: DataFrame) -> DataFrame:
    """Over 1, 5 and 20 bars; gaps in the closes are filled first."""
    out = df.withColumn("__c", filled("close"))
    return add_if_missing(out, {f"return_{n}d": zero(pct("__c", n)) for n in (1, 5, 20)}).drop("__c")


def volatility(df: DataFrame, name: str = "rolling_volatility", n: int = 20) -> DataFrame:
    out = df.withColumn("__c", filled("close")).withColumn("__r", pct("__c"))
    return add_if_missing(out, {name: zero(rolling(F.stddev_pop, "__r", n, 1))}).drop("__c", "__r")


def support(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.withColumns({"__lo": rolling(F.min, "low", n, 1), "__hi": rolling(F.max, "high", n, 1)})
    c = F.col("close")
    broke = F.when(c > lag("__hi"), 1).when(c < lag("__lo"), -1).otherwise(0).cast("tinyint")
    return add_if_missing(out, {"support_distance": zero(td(c - F.col("__lo"), c)), "resistance_distance": zero(td(F.col("__hi") - c, c)), "breakout_signal": broke}).drop("__lo", "__hi")


def volume_signals(df: DataFrame, n: int = 20) -> DataFrame:
    mean, spread = rolling(F.avg, "volume", n, 1), rolling(F.stddev_pop, "volume", n, 1)
    return add_if_missing(df, {"volume_momentum": zero(td(F.col("volume"), F.nullif(mean, F.lit(0.0))) - 1), "volume_spike": flag(F.col("volume") > mean + spread * 2)})


def close_lags(df: DataFrame, steps: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    return add_if_missing(df, {f"lag_{n}": zero(lag("close", n)) for n in steps})


def close_rolling(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    kinds = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return add_if_missing(df, {f"rolling_{k}_{n}": zero(rolling(f, "close", n, 1)) for n in windows for k, f in kinds.items()})


def shape_rolling(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Needs candle_shape."""
    made = {}
    for c in ("body_size", "upper_shadow", "lower_shadow"):
        for n in windows:
            made |= {f"{c}_rolling_mean_{n}": zero(rolling(F.avg, c, n, 1)), f"{c}_rolling_std_{n}": zero(rolling(F.stddev_pop, c, n, 1)), f"{c}_rolling_zscore_{n}": zero(zscore(c, n, 1))}
    return add_if_missing(df, made)


def patterns(df: DataFrame) -> DataFrame:
    """One- to three-bar candle patterns; a bar without range has none that needs a ratio.  Needs
    candle_shape."""
    out = df.withColumns({"__body": F.when(F.col("high_low_range") > TINY, F.col("body_ratio")), "__place": F.when(F.col("high_low_range") > TINY, F.col("close_position"))})
    o, c, body, up, low, d = (F.col(x) for x in ("open", "close", "body_size", "upper_shadow", "lower_shadow", "candle_direction"))
    o1, c1, r1, o2, c2, r2 = lag("open"), lag("close"), lag("__body"), lag("open", 2), lag("close", 2), lag("__body", 2)
    rises, falls, middle = c > o, c < o, (o2 + c2) / 2
    at_bottom = F.col("__place") <= 0.4
    long_upper = (up >= body * 2) & (low <= body) & at_bottom
    made = {
        "doji": F.col("__body") <= 0.1,
        "hammer": (low >= body * 2) & (up <= body) & (F.col("__place") >= 0.6),
        "inverted_hammer": long_upper & (d >= 0),
        "shooting_star": long_upper & (d <= 0),
        "bullish_engulfing": (c1 < o1) & rises & (o <= c1) & (c >= o1),
        "bearish_engulfing": (c1 > o1) & falls & (o >= c1) & (c <= o1),
        "morning_star": (c2 < o2) & (r2 > 0.5) & (r1 <= 0.3) & rises & (c >= middle),
        "evening_star": (c2 > o2) & (r2 > 0.5) & (r1 <= 0.3) & falls & (c <= middle),
    }
    return add_if_missing(out, {k: flag(v) for k, v in made.items()}).drop("__body", "__place")


SIGNALS = ("higher_high", "lower_high", "higher_low", "lower_low", "breakout_20d", "breakdown_20d", "trend_strength_score")


def _extremes(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """__h and __l with the number of rows: the highest high and the lowest low."""
    df = extremes(df, True, "high", {n: f"__h{n}" for n in windows})
    return extremes(df, False, "low", {n: f"__l{n}" for n in windows})


def distances(df: DataFrame, windows: tuple[int, ...] = (20, 60, 120, 252)) -> DataFrame:
    c = F.col("close")
    made = {}
    for n in windows:
        made |= {f"distance_to_{n}d_high": zero(td(F.col(f"__h{n}") - c, c)), f"distance_to_{n}d_low": zero(td(c - F.col(f"__l{n}"), c))}
    return add_if_missing(_extremes(df, windows), made).drop(*(f"__{k}{n}" for n in windows for k in "hl"))


def breakouts(df: DataFrame, windows: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    """The close against the extremes of the n bars before."""
    out = _extremes(df, windows)
    made = {}
    for n in windows:
        made |= {f"breakout_{n}d": flag(F.col("close") > lag(f"__h{n}")), f"breakdown_{n}d": flag(F.col("close") < lag(f"__l{n}"))}
    return add_if_missing(out, made).drop(*(f"__{k}{n}" for n in windows for k in "hl"))


def swing_flags(df: DataFrame, n: int = 20) -> DataFrame:
    """Higher and lower highs and lows against the bar before, and how many in n bars."""
    h, l = F.col("high"), F.col("low")
    names = {"higher_high": h > lag("high"), "lower_high": h < lag("high"), "higher_low": l > lag("low"), "lower_low": l < lag("low")}
    out = add_if_missing(df, {k: flag(v) for k, v in names.items()})
    return add_if_missing(out, {f"{k}_count_{n}": F.sum(F.col(k).cast("double")).over(trailing(n)) for k in names})


def year_extremes(df: DataFrame, n: int = 252, near: float = 0.05) -> DataFrame:
    c = F.col("close")
    steps = tuple(m for m in (20, 60, 120) if m < n) + (n,)
    out = _extremes(df, steps).withColumns({"__h": td(F.col(f"__h{n}") - c, c), "__l": td(c - F.col(f"__l{n}"), c)})
    out = out.drop(*(f"__{k}{m}" for m in steps for k in "hl"))
    return add_if_missing(out, {"distance_to_52w_high": zero(F.col("__h")), "distance_to_52w_low": zero(F.col("__l")), "near_52w_high": flag(F.col("__h") <= near), "near_52w_low": flag(F.col("__l") <= near)}).drop("__h", "__l")


def volume_confirmation(df: DataFrame, n: int = 20, windows: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    """Needs breakouts."""
    ratio = td(F.col("volume"), F.nullif(rolling(F.avg, "volume", n, 1), F.lit(0.0)))
    any_of = lambda k: reduce(lambda a, b: a | b, (F.col(f"{k}_{w}d") > 0 for w in windows))
    return add_if_missing(df, {"breakout_volume_ratio": F.when(any_of("breakout"), zero(ratio)).otherwise(F.lit(0.0)), "breakdown_volume_ratio": F.when(any_of("breakdown"), zero(ratio)).otherwise(F.lit(0.0)), "volume_spike_ratio": zero(ratio), "volume_momentum": zero(ratio - 1)})


def atr_ratio(df: DataFrame) -> DataFrame:
    """Needs ranges."""
    return add_if_missing(df, {"atr_ratio": zero(td(F.col("atr_14"), F.nullif(F.col("atr_20"), F.lit(0.0))))})


def trend_strength(df: DataFrame, n: int = 20) -> DataFrame:
    """Half the balance of swing counts, half the place in the channel.  Needs swing_flags."""
    low, high = rolling(F.min, "low", n, 1), rolling(F.max, "high", n, 1)
    place = F.coalesce(td(F.col("close") - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.5))
    balance = (F.col(f"higher_high_count_{n}") + F.col(f"higher_low_count_{n}") - F.col(f"lower_high_count_{n}") - F.col(f"lower_low_count_{n}")) / n
    return add_if_missing(df, {"trend_strength_score": zero(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), balance * 0.5 + (place * 2 - 1) * 0.5)))})


def trend_persistence(df: DataFrame, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    out = df.withColumn("__s", F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)))
    return add_if_missing(out, {f"trend_persistence_{n}": zero(rolling(F.avg, "__s", n, 1)) for n in windows}).drop("__s")


def signal_lags(df: DataFrame, signals: tuple[str, ...] = SIGNALS, steps: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    kinds = dict(df.dtypes)
    return add_if_missing(df, {f"{s}_lag_{n}": F.coalesce(lag(s, n), F.lit(0)).cast(kinds[s]) for s in signals for n in steps})


@dataclass(frozen=True)
class Structure:
    """Which windows the structure families are made with."""

    enabled: bool = True
    windows: tuple[int, ...] = (20, 60, 120, 252)
    breakouts: tuple[int, ...] = (20, 60, 120)
    count: int = 20
    near: float = 0.05
    volume: int = 20
    trends: tuple[int, ...] = (20, 60)
    lags: tuple[int, ...] = (1, 3, 5, 10, 20)


def market_structure(df: DataFrame, s: Structure = Structure()) -> DataFrame:
    """All structure families in their fixed order.  A missing column of the bars is an error."""
    ohlcv_contract(df)
    if not s.enabled:
        return df
    df = swing_flags(breakouts(distances(df, s.windows), s.breakouts), s.count)
    df = volume_confirmation(year_extremes(df, near=s.near), s.volume, s.breakouts)
    df = df.transform(ranges).transform(atr_ratio)
    df = volatility(volatility(df, "rolling_volatility_20", 20), "rolling_volatility_60", 60)
    df = trend_persistence(trend_strength(df, s.count), s.trends)
    return signal_lags(df, tuple(c for c in SIGNALS if c in df.columns), s.lags)


def candlesticks(df: DataFrame) -> DataFrame:
    """All candle families in their fixed order (the smoothed bodies are in recurrences)."""
    for family in (candle_shape, gaps, shape_changes, ranges, percent_sizes, returns, volatility, support, volume_signals, close_lags, close_rolling, shape_rolling, patterns):
        df = df.transform(family)
    return df


STRUCTURE = (distances, breakouts, swing_flags, year_extremes, volume_confirmation, ranges, atr_ratio, trend_strength, trend_persistence, signal_lags)


def structure_metadata(before: list[str], after: list[str], windows: tuple[int, ...] = (20, 60, 120, 252)) -> dict:
    """Which structure columns are new and which were kept from the input."""
    return {"generated": [c for c in after if c not in before], "preserved": [c for c in before if c in after], "windows": list(windows)}


def amount(df: DataFrame) -> DataFrame:
    """Volume times the mean price of the bar, 0 without a volume column."""
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    return df.withColumn("amount", F.col("volume") * mean if "volume" in df.columns else F.lit(0.0))
