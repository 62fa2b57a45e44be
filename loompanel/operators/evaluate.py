"""Evaluation of predictions (tic, grp, date, prediction, target): metrics, backtest, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.functions.columns import P, td
from loompanel.functions.ranks import with_earlier, with_place

YEAR = 252
LOWER = ("loss", "mse", "rmse", "mae", "mape", "max_drawdown")


def batch_score(windows: DataFrame, predict: Callable, unsquash: float | None = None) -> DataFrame:
    """(tic, date, prediction) of a caller's function of a list of feature arrays, called on batches."""
    from loompanel.operators.prepare import unsquashed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"tic": f["tic"], "date": f["date"], "prediction": predict(f["features"].tolist())})

    out = windows.select("tic", "date", "features").mapInPandas(run, "tic string, date date, prediction double")
    return out.withColumn("prediction", unsquashed(F.col("prediction"), unsquash)) if unsquash else out


def ensemble(members: DataFrame, weights: dict[str, float] | None = None, keys: tuple[str, ...] = ("tic", "date")) -> DataFrame:
    """Weighted mean over members (member, keys, prediction); every key needs every member."""
    names = list(weights) if weights else [r.member for r in members.select("member").distinct().orderBy("member").collect()]
    if weights and (min(weights.values()) < 0 or sum(weights.values()) <= 0):
        raise ValueError("weights have to be positive")
    share = {m: (weights[m] / sum(weights.values()) if weights else 1 / len(names)) for m in names}
    w = F.coalesce(*(F.when(F.col("member") == m, F.lit(s)) for m, s in share.items()))
    out = members.where(F.col("member").isin(names)).groupBy(*keys).agg(F.sum(F.col("prediction") * w).alias("prediction"), F.count(F.lit(1)).alias("__n"))
    return out.where(F.col("__n") == len(names)).drop("__n")


def sign_hit() -> Column:
    return (F.signum("prediction") == F.signum("target")).cast("int")


def regression(df: DataFrame, *by: str) -> DataFrame:
    """mse, rmse, mae, r2, mape (null if a target is 0 but its prediction is not), hit rate."""
    e = F.col("prediction") - F.col("target")
    bad = F.sum(((F.col("target") == 0) & (e != 0)).cast("int"))
    share = F.avg(F.abs(td(e, F.nullif(F.col("target"), F.lit(0.0))))) * 100
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - td(F.avg(e * e), F.nullif(F.var_pop("target"), F.lit(0.0)))).alias("r2"), F.when(bad == 0, share).alias("mape"),
        F.sum((F.col("target") == 0).cast("bigint")).alias("n_zero_targets"), F.avg(sign_hit()).alias("directional_accuracy"),
    )


def positions(df: DataFrame, threshold: float = 0.0, commission: float = 0.001, per_ticker: bool = False) -> DataFrame:
    """position, turnover, cost and net return of each row.

    The account runs over all rows by ticker and date (``per_ticker``: an account each).  Where a ticker
    begins, the position before is the last one of the ticker before it: found from one row for each
    ticker, not by a window over all rows.
    """
    p = F.col("prediction")
    out = df.withColumn("position", F.when(p > threshold, 1.0).when(p < -threshold, -1.0).otherwise(0.0))
    before = F.lag("position").over(P())
    if not per_ticker:
        ends = out.groupBy("tic").agg(F.max_by("position", "date").alias("__end"))
        ends = with_place(ends, ["tic"], "__k")
        ends = ends.join(ends.select((F.col("__k") + 1).alias("__k"), F.col("__end").alias("__carry")), "__k", "left").select("tic", "__carry")
        out = out.join(ends, "tic")
        before = F.coalesce(before, F.col("__carry"))
    turnover = F.abs(F.col("position") - F.coalesce(before, F.lit(0.0)))
    gross = F.col("position") * F.col("target")
    out = out.withColumns({"turnover": turnover, "gross_return": gross}).withColumn("cost", F.col("turnover") * commission * 100)
    return out.withColumn("net_return", F.col("gross_return") - F.col("cost")).drop("__carry")


def equity(df: DataFrame, column: str = "net_return", capital: float = 1.0) -> DataFrame:
    """Growth of the account by ticker and date, its highest so far and the drawdown.

    Two levels: running products inside tickers, times the product of the tickers before (one row each).
    """
    out = df.withColumn("__g", F.coalesce(F.col(column), F.lit(0.0)) / 100 + 1)
    inside = P().rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("__in", F.product("__g").over(inside))
    out = out.withColumn("__top", F.max("__in").over(inside))
    totals = out.groupBy("tic").agg(F.max_by("__in", "date").alias("g"), F.max("__in").alias("top"))
    carry = with_earlier(totals, ["tic"], F.col("g"), "__carry")
    carry = with_earlier(carry, ["tic"], F.col("__carry") * F.col("top"), "__before", "max").select("tic", "__carry", "__before")
    out = out.join(carry, "tic").withColumns({"equity": F.col("__in") * F.col("__carry") * capital, "__peak": F.greatest(F.col("__top") * F.col("__carry"), F.col("__before")) * capital})
    return out.withColumn("drawdown", td(F.col("equity") - F.col("__peak"), F.col("__peak"))).drop("__g", "__in", "__top", "__carry", "__before", "__peak")


def sharpe(c: Column, rate: float = 0.0) -> Column:
    return F.coalesce(td(F.avg(c) - rate / YEAR, F.nullif(F.stddev_pop(c), F.lit(0.0))) * F.sqrt(F.lit(float(YEAR))), F.lit(0.0))


def sortino(c: Column, rate: float = 0.0) -> Column:
    """Over the deviation of the negative returns around their own mean."""
    x = c - rate / YEAR
    return F.coalesce(td(F.avg(x), F.nullif(F.stddev_pop(F.when(x < 0, x)), F.lit(0.0))) * F.sqrt(F.lit(float(YEAR))), F.lit(0.0))


def trade_stats(df: DataFrame) -> DataFrame:
    """Of the net returns; a return of 0 is a loss."""
    r = F.col("net_return")
    win, loss = F.when(r > 0, r), F.when(~(r > 0), r)
    return df.agg(
        F.count(F.lit(1)).alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        (F.coalesce(F.sum(win), F.lit(0.0)) / F.coalesce(F.nullif(F.abs(F.sum(loss)), F.lit(0.0)), F.lit(1.0))).alias("profit_factor"), F.sum((F.col("turnover") > 0).cast("bigint")).alias("position_changes"),
        F.sum("turnover").alias("total_turnover"), F.sum("cost").alias("total_cost"), F.sum("net_return").alias("total_return"),
    )


def sector_direction(df: DataFrame, by: str = "grp") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.sum(sign_hit()).alias("correct"), F.avg(sign_hit()).alias("accuracy"))


def sector_extended(df: DataFrame, by: str = "grp") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.sum(sign_hit()).alias("correct"), F.avg(sign_hit()).alias("accuracy"), F.avg("target").alias("mean_real"), F.stddev_samp("target").alias("std_real"), F.avg("prediction").alias("mean_predicted"), F.stddev_samp("prediction").alias("std_predicted"))


def backtest(df: DataFrame, threshold: float = 0.0, commission: float = 0.001) -> DataFrame:
    """One row: trade statistics, Sharpe, Sortino, last equity and worst drawdown."""
    rows = equity(positions(df, threshold, commission))
    risk = rows.agg(sharpe(F.col("net_return")).alias("sharpe"), sortino(F.col("net_return")).alias("sortino"), F.max_by("equity", F.struct("tic", "date")).alias("final_equity"), F.min("drawdown").alias("max_drawdown"))
    return trade_stats(rows).join(F.broadcast(risk))


def report(df: DataFrame) -> DataFrame:
    """Rows with distance, direction score and the ticker's deviations."""
    t = W.partitionBy("tic")
    return df.select("tic", "grp", "date", "target", "prediction", F.abs(F.col("prediction") - F.col("target")).alias("distance"), sign_hit().alias("direction_score"), F.stddev_samp("target").over(t).alias("std_real"), F.stddev_samp("prediction").over(t).alias("std_predicted"))


def compare_models(metrics: DataFrame) -> DataFrame:
    """Best model of each metric of a long table (model, metric, value): least of the losses (and, as the
    drawdown counts among them, the deepest drawdown), else the largest; first by name of equals."""
    v, m = F.col("value"), F.col("model")
    low = F.col("metric").isin(*LOWER)
    known = metrics.where("value IS NOT NULL")
    return known.groupBy("metric").agg(F.when(F.first(low), F.min_by(m, F.struct(v, m))).otherwise(F.min_by(m, F.struct(-v, m))).alias("best_model"), F.when(F.first(low), F.min(v)).otherwise(F.max(v)).alias("best_value"))


def health(df: DataFrame) -> DataFrame:
    """One row of rates, mean and deviation of predictions; zeros for an empty table."""
    p, t = F.col("prediction"), F.col("target")
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    c = F.coalesce(F.expr("CASE WHEN stddev_pop(prediction) > 0 AND stddev_pop(target) > 0 THEN corr(prediction, target) END"), F.lit(0.0))
    return df.agg(rate(p > 0).alias("positive_rate"), rate(p < 0).alias("negative_rate"), rate(p == 0).alias("zero_rate"), F.coalesce(F.avg(p), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("std"), rate(t > 0).alias("target_positive_rate"), c.alias("correlation"))


def collapse_penalty(h: DataFrame, one_sided: float = 0.999, least_std: float = 1e-5) -> DataFrame:
    fell = (F.greatest("positive_rate", "negative_rate", "zero_rate") >= one_sided) | (F.col("std") <= least_std)
    short = F.greatest(F.lit(least_std) - F.col("std"), F.lit(0.0))
    return h.withColumn("penalty", F.when(fell, F.lit(1000.0) + F.abs(F.col("positive_rate") - 0.5) * 100 + short * 1e5).otherwise(F.lit(0.0)))


def meta_labels(df: DataFrame, source: str = "model", out_of_sample: bool = True, least_confidence: float = 0.0) -> DataFrame:
    p = F.col("prediction")
    out = df.select("tic", "date", p.alias("prediction"), "target", F.signum(p).cast("int").alias("direction"), F.signum("target").cast("int").alias("target_direction"), F.abs(p).alias("confidence"), sign_hit().alias("label"), F.lit(source).alias("source"), F.lit(out_of_sample).alias("is_oos"))
    return out.where(F.col("confidence") >= least_confidence)


def losses(df: DataFrame, alpha: float = 0.5, q: float = 0.9, delta: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Directional (mse and huber base), pinball, soft-Sharpe losses over all rows, as metrics."""
    p, t = F.col("prediction"), F.col("target")
    e = t - p
    wrong = F.avg(F.greatest(-p * F.signum(t), F.lit(0.0))) * alpha
    huber = F.avg(F.when(F.abs(e) <= delta, e * e * 0.5).otherwise((F.abs(e) - delta / 2) * delta))
    s = F.tanh(p) * t
    return df.agg((F.avg(e * e) + wrong).alias("directional_mse"), (huber + wrong).alias("directional_huber"), F.avg(F.greatest(e * q, e * (q - 1))).alias("pinball"), (-F.avg(s) / (F.stddev_pop(s) + eps)).alias("soft_sharpe"))


def cost_adjusted_loss(df: DataFrame, cost: float = 0.001, weight: float = 1.0) -> DataFrame:
    """mse + weight * cost - net return of tanh positions; turnover between neighbouring rows of a ticker."""
    out = df.withColumn("__p", F.tanh("prediction"))
    out = out.withColumn("__t", F.abs(F.col("__p") - F.coalesce(F.lag("__p").over(P()), F.col("__p"))))
    e = F.col("prediction") - F.col("target")
    return out.agg((F.avg(e * e) + F.avg(F.col("__t") * cost) * weight - F.avg(F.col("__p") * F.col("target") - F.col("__t") * cost)).alias("cost_adjusted"))


def rich_loss(df: DataFrame, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """Rows with prediction/target, path_hat/path and block_hat/block arrays, logits and label: the weighted
    sum of their squared errors and of the cross-entropy."""
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    e = F.col("prediction") - F.col("target")
    top = F.array_max("logits")
    logsum = top + F.ln(F.aggregate(F.transform("logits", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, v: s + v))
    parts = [e * e, sq("path_hat", "path"), sq("block_hat", "block"), logsum - F.element_at("logits", F.col("label") + 1)]
    return df.agg(sum((F.avg(p) * w for p, w in zip(parts, weights)), F.lit(0.0)).alias("rich_loss"))


def forecast_summary(df: DataFrame, column: str = "quantile_paths") -> DataFrame:
    """Median, mean and deviation over the quantile paths (an array of arrays) at every step."""
    a = F.col(column)
    steps = F.sequence(F.lit(0), F.size(a[0]) - 1)
    at = lambda i: F.transform(a, lambda r: r[i])
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)

    def median(x: Column) -> Column:
        s = F.array_sort(x)
        n = F.size(x)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2

    def deviation(x: Column) -> Column:
        m = mean(x)
        return F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))))

    return df.withColumns({"median_path": F.transform(steps, lambda i: median(at(i))), "mean_path": F.transform(steps, lambda i: mean(at(i))), "std_path": F.transform(steps, lambda i: deviation(at(i)))})


def named_ids(df: DataFrame, names: DataFrame, id_col: str, name: str, prefix: str) -> DataFrame:
    """The name of an id, or prefix_id."""
    from loompanel.operators.joins import small

    return df.join(small(names.select(id_col, name)), id_col, "left").withColumn(name, F.coalesce(F.col(name), F.concat(F.lit(prefix), F.col(id_col).cast("string"))))
