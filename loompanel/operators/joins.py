"""Joins of the panel with macro series, fundamentals and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.functions.columns import td
from loompanel.functions.ranks import held

#: Rows of a date-keyed macro table that are broadcast: 270 years of days.
BROADCAST_DATES = 100_000


def small(df: DataFrame, bound: int = BROADCAST_DATES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows; else it is joined by sorting.

    A small table is held as it is found, so what it is made of runs once for both."""
    few = held(df, bound)
    return df if few is None else F.broadcast(few)


def merge_macro(panel: DataFrame, vix: DataFrame | None = None, commodities: DataFrame | None = None, yields: DataFrame | None = None) -> DataFrame:
    """Left joins by date of the series given; gaps stay null."""
    for macro in (vix, commodities, yields):
        panel = panel.join(small(macro), "date", "left") if macro is not None else panel
    return panel


def ratios(statements: DataFrame) -> DataFrame:
    """tic, date, roe, roi, debt_to_equity, debt_to_asset, current_ratio; null over a denominator of 0."""
    pairs = {"roe": ("netIncome", "totalStockholderEquity"), "roi": ("netIncome", "totalAssets"), "debt_to_equity": ("totalLiab", "totalStockholderEquity"), "debt_to_asset": ("totalLiab", "totalAssets"), "current_ratio": ("totalCurrentAssets", "totalCurrentLiabilities")}
    return statements.select("tic", "date", *(td(F.col(a), F.nullif(F.col(b), F.lit(0.0))).alias(k) for k, (a, b) in pairs.items()))


def _bars_and_quarters(bars: DataFrame, quarters: DataFrame, columns: list[str]) -> DataFrame:
    """Bars (``__bar`` 1) and the quarters (0) that are not before the ticker's first bar."""
    rows = bars.select("tic", "date", *(F.lit(None).cast("double").alias(c) for c in columns), F.lit(1).alias("__bar"))
    rows = rows.unionByName(quarters.select("tic", "date", *columns, F.lit(0).alias("__bar")))
    first = F.min(F.when(F.col("__bar") == 1, F.col("date"))).over(W.partitionBy("tic"))
    return rows.withColumn("__first", first).where("date >= __first").drop("__first")


def as_of(bars: DataFrame, quarters: DataFrame, columns: list[str]) -> DataFrame:
    """For each bar the last known value of each column, of quarters from the ticker's first bar on.

    Bars and quarters are put in one order by ticker and date: one shuffle, one pass, no range join.
    """
    rows = _bars_and_quarters(bars, quarters, columns)
    order = W.partitionBy("tic").orderBy("date", "__bar").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("tic", "date", "__bar", *(F.last(c, ignorenulls=True).over(order).alias(c) for c in columns)).where("__bar = 1").drop("__bar")


def interpolate(bars: DataFrame, quarters: DataFrame, columns: list[str]) -> DataFrame:
    """Linear in days between known quarters; the last value after them, null before."""
    rows = _bars_and_quarters(bars, quarters, columns)
    order = W.partitionBy("tic").orderBy("date", "__bar")
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    made = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("date"))
        a, b = F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)
        da, db = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
        share = td(F.datediff("date", da).cast("double"), F.nullif(F.datediff(db, da), F.lit(0)).cast("double"))
        made[f"__i_{c}"] = F.when(b.isNull() | share.isNull(), a).otherwise(a + (b - a) * share)
    return rows.withColumns(made).where("__bar = 1").select("tic", "date", *(F.col(f"__i_{c}").alias(c) for c in columns))


def date_grid(bars: DataFrame) -> DataFrame:
    """All calendar days of each ticker from its first to its last bar."""
    ends = bars.groupBy("tic").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.select("tic", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date"))


def daily_fundamentals(bars: DataFrame, quarters: DataFrame, highlights: DataFrame, fill: str = "ffill") -> DataFrame:
    """Ratios as of each bar and the ticker's highlights; tickers without quarters get neither."""
    columns = [c for c in quarters.columns if c not in ("tic", "date")]
    daily = (as_of if fill == "ffill" else interpolate)(bars, quarters, columns)
    known = quarters.select("tic").distinct()
    return daily.join(highlights.join(known, "tic", "left_semi"), "tic", "left")


def inference_defaults(df: DataFrame) -> DataFrame:
    """Missing fundamentals columns: flag 2, the rest 0."""
    wanted = ("pe_ratio", "peg_ratio", "eps", "roe", "roi", "debt_to_equity", "debt_to_asset", "current_ratio")
    made = {c: F.lit(0.0) for c in wanted if c not in df.columns}
    return df.withColumns(made | ({} if "dividend_flag" in df.columns else {"dividend_flag": F.lit(2).cast("tinyint")}))


def realign(normalised: DataFrame, raw: DataFrame, keys: tuple[str, ...] = ("date", "tic_id"), value: str = "close") -> DataFrame:
    """The normalised rows with the raw value; a row without one is an error."""
    raw = raw.select(*keys, F.col(value).alias(f"raw_{value}"))
    lost = normalised.join(raw, list(keys), "left_anti").limit(1).count()
    if lost:
        raise ValueError("rows without a raw value")
    return normalised.join(raw, list(keys))


def same_sector_pairs(panel: DataFrame) -> DataFrame:
    """(grp, date, tic, peer, y, x) for all tickers of a sector on one date."""
    a = panel.select("grp", "date", "tic", F.col("close").alias("y"))
    b = panel.select("grp", "date", F.col("tic").alias("peer"), F.col("close").alias("x"))
    return a.join(b, ["grp", "date"]).where("tic <> peer")

