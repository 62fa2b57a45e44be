"""Balanced choice of tickers over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def balanced(tickers: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n of the tickers (tic, grp, market_cap; one row for each), all groups covered.

    Each group gives its n // groups first by market cap (unknown last, then by name), the rest come from
    the common order.  With fewer places than groups, the groups of the largest caps give their first.
    ``seed``: by the MD5 of "seed|tic" instead of the caps.
    """
    order: list[Column] = [F.desc_nulls_last("market_cap"), F.asc("tic")] if seed is None else [F.md5(F.concat(F.lit(f"{seed}|"), "tic")).asc(), F.asc("tic")]
    groups = tickers.select("grp").distinct().count()
    if not groups or n <= 0:
        return tickers.limit(0)
    ranked = tickers.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(*order)))
    share = n // groups
    if share == 0:
        return ranked.where("rank = 1").orderBy(*order).limit(n).drop("rank")
    sure = ranked.where(F.col("rank") <= share)
    left = n - sure.count()
    rest = ranked.where(F.col("rank") > share).orderBy(*order).limit(max(left, 0))
    return sure.union(rest).drop("rank")


def sample_stats(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("grp").agg(F.countDistinct("tic").alias("tickers"))
