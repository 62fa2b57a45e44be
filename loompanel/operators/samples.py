"""Fixed-length samples from panels: one row for each window, features as an array of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loompanel.functions.columns import P, trailing
from loompanel.functions.quantiles import grouped_quantiles


def _windows(df: DataFrame, features: list[str], length: int, ids: tuple[str, ...] = ()) -> DataFrame:
    """Rows that end a whole window without unknown features: features, ids and start (from 0)."""
    w = trailing(length)
    unknown = F.greatest(*(F.col(c).isNull().cast("int") for c in features)) if len(features) > 1 else F.col(features[0]).isNull().cast("int")
    out = df.withColumns(
        {
            "__n": F.count(F.lit(1)).over(w), "__unknown": F.sum(unknown).over(w), "start": F.row_number().over(P()) - length,
            "features": F.collect_list(F.array(*(F.col(c).cast("float") for c in features))).over(w),
            **{f"{c}_seq": F.collect_list(F.col(c).cast("bigint")).over(w) for c in ids},
        }
    )
    return out, (F.col("__n") == length) & (F.col("__unknown") == 0)


def default_ids(df: DataFrame) -> DataFrame:
    """No group: 0.  No dividend flag: 1."""
    made = {c: F.lit(v) for c, v in (("group_id", 0), ("dividend_flag", 1)) if c not in df.columns}
    return df.withColumns(made) if made else df


def training_windows(df: DataFrame, features: list[str], length: int, horizon: int, label_offset: int | None = None, stride: int = 1, ids: tuple[str, ...] = ("tic_id", "group_id", "day", "month", "dividend_flag")) -> DataFrame:
    """tic, date (of the window's last row), start, features, ids, target.

    The label is the target ``label_offset`` rows after the window's last one (``horizon`` if not given: the
    target looks ahead itself, so labels span horizon to twice horizon)."""
    offset = horizon if label_offset is None else label_offset
    ids = tuple(c for c in ids if c in df.columns)
    out, whole = _windows(df.withColumn("__y", F.lead("target", offset).over(P())), features, length, ids)
    return out.where(whole & F.col("__y").isNotNull() & (F.col("start") % stride == 0)).select("tic", "date", "start", "features", *(f"{c}_seq" for c in ids), F.col("__y").cast("float").alias("target"))


def window_index(df: DataFrame, features: list[str], length: int, horizon: int, stride: int = 1) -> DataFrame:
    """(tic, start, target_idx) of the windows, without their arrays."""
    w = trailing(length)
    unknown = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    out = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__u": F.sum(unknown).over(w), "start": F.row_number().over(P()) - length, "__y": F.lead("target", horizon).over(P())})
    return out.where((F.col("__n") == length) & (F.col("__u") == 0) & F.col("__y").isNotNull() & (F.col("start") % stride == 0)).select("tic", "start", (F.col("start") + length + horizon - 1).alias("target_idx"))


def inference_windows(df: DataFrame, features: list[str], length: int) -> DataFrame:
    """A window at every row from the length-th on, keyed by ticker and date."""
    out, whole = _windows(df, features, length)
    return out.where(whole).select("tic", "date", "start", "features")


def trend_path(values: Column, horizon: int, lookback: int) -> Column:
    """last + k * mean gap of the last max(2, lookback) values, k = 0 to horizon - 1."""
    n = F.least(F.size(values), F.lit(max(2, lookback)))
    last, first = F.element_at(values, -1), F.element_at(values, -n)
    gap = F.when(n > 1, (last - first) / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: last + gap * k)


def trend_samples(df: DataFrame, features: list[str], length: int, horizon: int, lookback: int = 5, scalar: bool = True) -> DataFrame:
    """Windows with the trend of the close carried on, a mask of ones and the scalar label (or 0)."""
    out, whole = _windows(df.withColumns({"__y": F.lead("target", horizon).over(P()), "__c": F.collect_list("close").over(trailing(length))}), features, length)
    label = F.col("__y").cast("float") if scalar else F.lit(0.0).cast("float")
    return out.where(whole & F.col("__y").isNotNull()).select("tic", "date", "start", "features", trend_path(F.col("__c"), horizon, lookback).alias("future_path"), F.array_repeat(F.lit(1.0), horizon).alias("mask"), label.alias("target"))


def array_std(a: Column) -> Column:
    """Population deviation of an array."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))


def rich_samples(df: DataFrame, features: list[str], length: int, horizon: int) -> DataFrame:
    """Windows with the bars that follow: OHLCV block, close path, returns over the last close in percent,
    volatility of the steps over the last close.  Windows whose last close is about 0 are left out."""
    ahead = P().rowsBetween(1, horizon)
    out, whole = _windows(df.withColumns({"label_date": F.lead("date", horizon).over(P()), "__b": F.collect_list(F.array("open", "high", "low", "close", "volume")).over(ahead), "__p": F.collect_list("close").over(ahead), "__y": F.lead("target", horizon).over(P())}), features, length)
    last = F.col("close")
    rows = out.where(whole & (F.size("__p") == horizon) & (F.abs(last) >= 1e-8) & F.col("__y").isNotNull())
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: (F.element_at("__p", i) - F.when(i == 1, last).otherwise(F.element_at("__p", F.greatest(i - 1, F.lit(1))))) / last)
    return rows.select("tic", "date", "start", "label_date", "features", F.col("__b").alias("future_ohlcv"), F.col("__p").alias("close_path"), F.transform("__p", lambda x: (x / last - 1) * 100).alias("return_path"), array_std(steps).alias("volatility"), F.col("__y").cast("float").alias("target"))


def regime_labels(samples: DataFrame, existing: DataFrame | None = None, included: bool = True, split: str = "split") -> DataFrame:
    """regime_label of each sample: the regime (tic, date, regime_id) of its label row where ``existing`` is given
    (``label_date``; 1 if there is none), else by volatility; 0 if labels are not wanted."""
    if not included:
        return samples.withColumn("regime_label", F.lit(0))
    if existing is None:
        return volatility_regime(samples, split)
    known = existing.select("tic", F.col("date").alias("label_date"), F.col("regime_id").cast("int").alias("regime_label"))
    return samples.join(known, ["tic", "label_date"], "left").withColumn("regime_label", F.coalesce("regime_label", F.lit(1)))


def volatility_regime(samples: DataFrame, split: str = "split", low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """0, 1 or 2 by the volatility quantiles of each split (exact, one job for all splits; memory is bounded)."""
    cuts = grouped_quantiles(samples, split, ["volatility"], (low, high))
    rows = [(g, *q["volatility"]) for g, q in cuts.items()]
    table = samples.sparkSession.createDataFrame(rows, f"__s {samples.schema[split].dataType.simpleString()}, __a double, __b double")
    v = F.col("volatility")
    label = F.when(v <= F.col("__a"), 0).when(v >= F.col("__b"), 2).otherwise(1)
    return samples.join(F.broadcast(table), F.col(split).eqNullSafe(F.col("__s"))).withColumn("regime_label", label).drop("__s", "__a", "__b")


def tuning_split(df: DataFrame, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """70/20/10 by date."""
    from loompanel.operators.prepare import date_split

    return date_split(df, train, val)


def tuning_windows(df: DataFrame, features: list[str], length: int) -> DataFrame:
    """Windows whose label is the first feature of the row after them, with that row's ids."""
    out, whole = _windows(df.withColumns({"__y": F.lead(features[0]).over(P()), "__d": F.lead("date").over(P())}), features, length)
    return out.where(whole & F.col("__y").isNotNull()).select("tic", "start", F.col("__d").alias("date"), "features", F.col("__y").cast("float").alias("target"))


def sample_metadata(df: DataFrame, length: int, horizon: int, squash: float | None = None) -> DataFrame:
    """Dates of each window and of the bars after it, last and future close, the return between them."""
    from loompanel.operators.prepare import squashed

    out = df.withColumns({"x_dates": F.collect_list("date").over(trailing(length)), "y_dates": F.collect_list("date").over(P().rowsBetween(1, horizon)), "future_close": F.lead("close", horizon).over(P())})
    rows = out.where((F.size("x_dates") == length) & (F.size("y_dates") == horizon))
    realised = (F.col("future_close") / F.nullif(F.col("close"), F.lit(0.0)) - 1) * 100
    return rows.select("tic", "date", "x_dates", "y_dates", F.col("close").alias("last_close"), "future_close", realised.alias("realised"), (squashed(realised, squash) if squash else realised).alias("realised_scaled"))


def head(samples: DataFrame, n: int) -> DataFrame:
    return samples.orderBy("tic", "start").limit(max(n, 0))


def flatten(df: DataFrame, column: str, shape: list[int], names: list[str] | None = None) -> DataFrame:
    """One column for each step of an array, or for each step and name of an array of arrays."""
    if len(shape) == 1:
        made = {f"{column}_t{i}": F.col(column)[i] for i in range(shape[0])}
    else:
        made = {f"{column}_{names[j] if names else j}_t{i}": F.col(column)[i][j] for i in range(shape[0]) for j in range(shape[1])}
    return df.withColumns(made).drop(column)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def normalise_window(rows: Column, channel: int, clip: float = 5.0) -> Column:
    """z-scores of a channel over the window (+1e-5 on the deviation), clipped."""
    x = F.transform(rows, lambda r: r[channel].cast("double"))
    mean, sd = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x), array_std(x)
    return F.transform(x, lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), (v - mean) / (sd + 1e-5))))


def denormalise_window(z: Column, mean: Column, sd: Column) -> Column:
    return F.transform(z, lambda v: v * (sd + 1e-5) + mean)


def embedding_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, size): largest id + 1; fixed sizes for day, month and dividend flag."""
    fixed = {"day": 32, "month": 13, "dividend_flag": 3}
    return df.agg(F.array(*(F.struct(F.lit(c).alias("column"), (F.lit(fixed[c]) if c in fixed else F.max(c) + 1).cast("bigint").alias("size")) for c in columns)).alias("s")).select(F.explode("s").alias("p")).select("p.*")


def preview(samples: DataFrame, k: int = 5) -> DataFrame:
    """The first k samples: target, length, first and last day and month (-1 if unknown) and the first five
    features of the last step."""
    ends = {}
    for c in ("day", "month"):
        known = f"{c}_seq" in samples.columns
        ends |= {f"start_{c}": F.element_at(f"{c}_seq", 1) if known else F.lit(-1).cast("long"), f"end_{c}": F.element_at(f"{c}_seq", -1) if known else F.lit(-1).cast("long")}
    return head(samples, k).select("tic", "date", "target", F.size("features").alias("length"), *(v.alias(n) for n, v in ends.items()), F.slice(F.element_at("features", -1), 1, 5).alias("last_step"))


