"""Whole pipelines: features of a panel, and its preparation for training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loompanel.operators import analyse as A
from loompanel.operators import features as X
from loompanel.operators import joins as J
from loompanel.operators import prepare as P
from loompanel.operators import recurrences as R
from loompanel.operators import sector as C
from loompanel.operators import trendlines as L
from loompanel.sources import sinks


@dataclass
class Settings:
    """Which families are made, and with which windows."""

    technical: bool = True
    geometric: bool = True
    trendlines: bool = False
    structure: bool = True
    fibonacci: bool = True
    candles: bool = True
    sector: bool = True
    pairs: bool = False
    pair_tests: bool = True
    equilibrium: bool = False
    pair_window: int = 252
    norm_window: int = 60
    pair_norm: int = 60
    structure_windows: X.Structure = X.Structure()
    horizon: int = 5
    squash: float | None = None
    train: float = 0.7
    val: float = 0.1
    scaler: str = "robust"
    regime_column: str | None = "vix"


def add_all_features(bars: DataFrame, s: Settings | None = None, statements: DataFrame | None = None, highlights: DataFrame | None = None, macro: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Calendar, technical, geometric, structure, Fibonacci, candles, fundamentals, sector, pairs, equilibrium,
    macro, target, in this order.  Families share one order by ticker, so they cost one shuffle; the sector family and the
    joins add theirs.  Bars and statements are read by several of them: what makes them runs once."""
    s = s or Settings()
    bars = sinks.materialise(bars, "bars")
    statements = sinks.materialise(statements, "statements") if statements is not None else None
    df = X.calendar(bars)
    if s.technical:
        df = R.technical(df)
    if s.geometric:
        for family in (X.roc, X.bollinger_width, X.channel, X.swings):
            df = family(df)
    if s.trendlines:
        df = L.trendlines(df)
    if s.structure:
        df = X.market_structure(df, s.structure_windows)
    if s.fibonacci:
        df = X.fibonacci(df)
    if s.candles:
        df = R.smoothed_bodies(X.candlesticks(df))
    if statements is not None:
        daily = J.daily_fundamentals(bars, J.ratios(statements), highlights) if highlights is not None else J.as_of(bars, J.ratios(statements), ["roe", "roi", "debt_to_equity", "debt_to_asset", "current_ratio"])
        df = df.join(daily, ["tic", "date"], "left")
    if s.sector:
        df = C.relative(df, s.norm_window)
    if s.pairs:
        pairs = C.spreads(bars, s.pair_window, s.pair_norm)
        df = df.join((C.spread_adf(bars, pairs, s.pair_window) if s.pair_tests else pairs).drop("peer"), ["tic", "date"], "left")
    if s.equilibrium:  # one row for each sector and day: broadcast by adaptive execution where that is little
        df = df.join(C.equilibrium(bars, s.pair_window, s.pair_norm), ["grp", "date"], "left")
    for m in macro:
        df = df.join(J.small(m), "date", "left")
    return P.target(df, s.horizon, s.squash)


def preprocess(df: DataFrame, s: Settings | None = None, export: str | None = None, required: tuple[str, ...] = ("tic", "date", "close", "target")) -> tuple[DataFrame, DataFrame]:
    """The encoded, split and normalised panel, and the scaler's parameters (column, center, scale).

    A missing required column is an error.  ``export``: where the encoded panel is written before anything is
    filled, for evaluations that need raw closes."""
    s = s or Settings()
    A.column_contract(df.columns, {"panel": list(required)})
    df = sinks.materialise(df, "panel")  # ids, dates, thresholds and scales are fitted on it, each by a job of its own
    for column, name in (("tic", "tic_id"), ("grp", "group_id")):
        df = P.encode(df, P.label_ids(df, column), column, name)
    if export:
        df.write.mode("overwrite").parquet(export)
    df = P.date_split(P.fill_target(df), s.train, s.val)
    if s.regime_column and s.regime_column in df.columns:
        df = P.regime(df, s.regime_column, P.fit_regime(df, s.regime_column))
    kinds = dict(df.dtypes)
    columns = [c for c in P.feature_columns(df) if kinds[c] in sinks.NUMERIC]
    df = P.fill_numbers(df, columns)
    params = P.fit_scaler(df, columns, s.scaler)
    return P.scale(df, params, s.scaler), params
