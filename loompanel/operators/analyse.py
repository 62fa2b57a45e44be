"""Tables about features: correlations, sparsity, importance, contracts."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.functions.moments import correlations
from loompanel.functions.quantiles import exact_quantiles


def family(c):
    """The family of a feature by its name."""
    rules = [("rsi_", "rsi"), ("stochrsi", "stochrsi"), ("ema_", "ema"), ("macd", "macd"), ("body_", "candlestick"), ("upper_shadow", "candlestick"), ("lower_shadow", "candlestick"), ("candle_", "candlestick"), ("doji", "candlestick"), ("hammer", "candlestick"), ("roe", "financial"), ("roi", "financial"), ("debt_", "financial"), ("pe_", "financial"), ("peg_", "financial"), ("eps", "financial"), ("current_ratio", "financial"), ("dividend", "financial"), ("vix", "macro"), ("bondyield", "macro"), ("commodity", "macro"), ("open", "price"), ("high", "price"), ("low", "price"), ("close", "price"), ("volume", "price")]
    out = F.when(F.startswith(c, F.lit(rules[0][0])), rules[0][1])
    for start, name in rules[1:]:
        out = out.when(F.startswith(c, F.lit(start)), name)
    return out.otherwise("other")


def _long(df: DataFrame, made: dict, *names: str) -> DataFrame:
    """One row for each feature from one aggregate over all rows."""
    rows = [F.struct(F.lit(f).alias("feature"), *(v.alias(n) for n, v in zip(names, values))) for f, values in made.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("p")).select("p.*")


def target_correlation(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    out = _long(df, {f: (F.corr(f, target),) for f in features}, "correlation")
    return out.withColumns({"abs_correlation": F.abs("correlation"), "family": family(F.col("feature"))})


def correlated_pairs(df: DataFrame, features: list[str], threshold: float | None = 0.9, signed: bool = False) -> DataFrame:
    """Pairs of features whose absolute correlation reaches the threshold (all without one), in one pass over the
    rows at any number of features.  ``signed``: the correlation itself."""
    r = F.col("correlation")
    found = correlations(df, features).where("i < j")
    found = found if threshold is None else found.where(F.abs(r) >= threshold)
    return found.select("a", "b", r if signed else F.abs(r).alias("abs_correlation"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs, both ways and with themselves, in one pass over the rows."""
    return correlations(df, columns).select("a", "b", "correlation")


def family_summary(correlations: DataFrame) -> DataFrame:
    c = F.col("abs_correlation")
    return correlations.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.max(c).alias("max"))


def distinct_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n_unique): exact, nulls left out.

    Two levels: a task gives each value of a feature once for each batch, and these are combined before they
    move; a value of a feature that is left counts one.  No row is repeated for a feature."""
    kinds = dict(df.dtypes)
    numbers = {f: kinds[f] in ("tinyint", "smallint", "int", "float", "double") for f in features}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, f in enumerate(features):
                found = batch.column(i).unique().drop_null()
                empty = pa.nulls(len(found), pa.string() if numbers[f] else pa.float64())
                pair = [found, empty] if numbers[f] else [empty, found]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int32()), *pair], ["i", "x", "t"])

    cast = df.select(*(F.col(f"`{f}`").cast("double" if numbers[f] else "string").alias(f"c{i}") for i, f in enumerate(features)))
    distinct = cast.mapInArrow(values, "i int, x double, t string").groupBy("i", "x", "t").agg(F.lit(1))
    return distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique")).select(F.get(F.array(*map(F.lit, features)), F.col("i")).alias("feature"), "n_unique")


def sparsity(df: DataFrame, features: list[str]) -> DataFrame:
    made = {f: (F.avg((F.col(f) == 0).cast("double")), F.stddev_samp(f)) for f in features}
    out = _long(df, made, "zero_ratio", "std").join(F.broadcast(distinct_counts(df, features)), "feature", "left")  # one row for each feature
    return out.select("feature", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "zero_ratio", "std")


def distribution(df: DataFrame, column: str = "target") -> DataFrame:
    median = F.lit(exact_quantiles(df, [column], (0.5,))[column][0]).cast("double")
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), median.alias("median"))


def group_counts(df: DataFrame, by: str = "grp") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("tic").alias("tickers"))


def attribution_importance(samples: DataFrame, column: str = "attributions", signed: bool = False) -> DataFrame:
    """(feature, importance, mean_attribution, mean_abs, rank) over all samples and steps."""
    flat = samples.select(F.explode(column).alias("step")).select(F.posexplode("step").alias("feature", "a"))
    flat = flat.withColumn("a", F.col("a").cast("double"))
    out = flat.groupBy("feature").agg(F.avg("a").alias("mean_attribution"), F.avg(F.abs("a")).alias("mean_abs"))
    out = out.withColumn("importance", F.col("mean_attribution") if signed else F.col("mean_abs"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("importance"), "feature")))


def attention_by_position(samples: DataFrame, column: str = "attention", k: int = 5) -> DataFrame:
    """Mean weight of each key position over samples and queries (rows of the matrix), largest k first."""
    flat = samples.select(F.explode(column).alias("q")).select(F.posexplode("q").alias("position", "w"))
    return flat.groupBy("position").agg(F.avg(F.col("w").cast("double")).alias("weight")).orderBy(F.desc("weight"), "position").limit(k)


def pruning(importance: DataFrame, share: float = 0.2, least: float | None = None, split: str = "val", allow_test: bool = False) -> DataFrame:
    """Features with rank and reasons to drop: lowest share, or at most the least importance."""
    if split in ("test", "holdout") and not allow_test:
        raise ValueError("importance of the test split must not choose features")
    n = importance.count()
    out = importance.withColumn("rank", F.row_number().over(W.orderBy(F.desc("importance"), "feature")))
    reasons = [F.when(F.col("rank") > n - ceil(n * share), F.lit("bottom_percent"))]
    if least is not None:
        reasons.append(F.when(F.col("importance") <= least, F.lit("min_importance")))
    return out.withColumn("reason", F.concat_ws(",", *reasons)).withColumn("drop", F.col("reason") != "")


def column_contract(columns: list[str], required: dict[str, list[str]], optional: dict[str, list[str]] | None = None) -> dict:
    """Raises on missing required columns; tells present and missing optional ones by category."""
    lost = [c for names in required.values() for c in names if c not in columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    return {k: {"present": [c for c in v if c in columns], "missing": [c for c in v if c not in columns]} for k, v in (optional or {}).items()}


#: Columns of a bar.
OHLCV = ("open", "high", "low", "close", "volume")


def ohlcv_contract(df: DataFrame) -> None:
    """Raises where a column of a bar is missing."""
    missing = sorted(set(OHLCV) - set(df.columns))
    if missing:
        raise ValueError(f"missing OHLCV columns: {missing}")


def null_counts(df: DataFrame, columns: tuple[str, ...] = OHLCV) -> DataFrame:
    """(feature, nulls, rows) of each column, in one pass; NaN counts as unknown."""
    unknown = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return _long(df, {c: (F.count_if(unknown(c)), F.count(F.lit(1))) for c in columns}, "nulls", "rows")


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of NaN, infinities and nulls of each column, in one pass."""
    inf = float("inf")
    made = {c: (F.count(F.when(F.isnan(c), 1)), F.count(F.when(F.col(c) == inf, 1)), F.count(F.when(F.col(c) == -inf, 1)), F.count(F.when(F.col(c).isNull(), 1))) for c in columns}
    return _long(df, made, "nan", "pos_inf", "neg_inf", "nulls")


def sanitise(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """NaN and infinities by a value, also inside arrays."""
    fixed = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(value)).otherwise(x)
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.transform(c, fixed) if kinds[c].startswith("array") else fixed(F.col(c)) for c in columns})


def split_overlap(df: DataFrame) -> DataFrame:
    """Dates that stand in more than one split."""
    return df.groupBy("date").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def same_columns(splits: dict[str, DataFrame], expected: list[str] | None = None) -> None:
    first = None
    for name, df in splits.items():
        first = first or set(df.columns)
        if set(df.columns) != first or (expected and not set(expected) <= set(df.columns)):
            raise ValueError(f"columns of {name} differ")


def flag_domain(samples: DataFrame, column: str = "dividend_flag_seq", ids: str = "tic_id_seq") -> DataFrame:
    """Samples whose flags are not 0, 1 or 2, or as many as the ids."""
    return samples.where(~F.forall(column, lambda x: x.isin(0, 1, 2)) | (F.size(column) != F.size(ids)))


def aligned(predictions: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("tic", "date")) -> DataFrame:
    """The two joined by key; a key of one side only is an error."""
    joined = predictions.withColumn("__p", F.lit(1)).join(targets.withColumn("__t", F.lit(1)), list(keys), "full")
    if joined.where("__p IS NULL OR __t IS NULL").limit(1).count():
        raise ValueError("predictions and targets do not share their keys")
    return joined.drop("__p", "__t")


def feature_inventory(spark, columns: list[str]) -> DataFrame:
    """Counts of the feature columns (all but date, tic, target) by family."""
    names = spark.createDataFrame([(c,) for c in columns if c not in ("date", "tic", "target")], "feature string")
    return names.groupBy(family(F.col("feature")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
