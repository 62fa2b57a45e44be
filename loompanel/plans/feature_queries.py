"""Queries of the feature families, each over the whole bar panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loompanel.functions.columns import rounded
from loompanel.operators import features as X
from loompanel.operators import recurrences as R
from loompanel.plans.adapters import view
from loompanel.plans.registry import OVER, lag_, over, panel_sql, query, r6, roll, ti, z

BARS = ("tic", "date", "open", "high", "low", "close", "volume")


def run(*families, places: int = 6):
    """A query that applies the families to the bars (of the tables if not given) and returns key and new columns."""

    def made(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
        out = (view(spark, sf_dir, "bars") if bars is None else bars).select(*BARS)
        for f in families:
            out = f(out)
        return rounded(out.select("tic", "date", *(c for c in out.columns if c not in BARS)), places)

    return made


def keep(f, *columns: str, but: tuple[str, ...] = ()):
    def made(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
        out = f(spark, sf_dir, bars)
        return out.select("tic", "date", *(columns or [c for c in out.columns[2:] if c not in but]))

    return made


C = "close"
TINY = 1e-8
SHAPE = f"""shape AS (SELECT *, abs(close - open) AS body_size, greatest(high - greatest(open, close), 0) AS upper_shadow,
 greatest(least(open, close) - low, 0) AS lower_shadow, high - low AS high_low_range, CASE WHEN high - low > {TINY} THEN high - low END AS rng FROM bars)"""

query("f01_calendar", panel_sql("CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS dayofweek"))(run(X.calendar))
query("f08_roc", panel_sql(r6({"roc_10": f"(close / {lag_(C, 10)} - 1) * 100"})))(run(X.roc))
query("f09_bollinger_width", panel_sql(r6({"bb_width_20": f"4 * {roll('stddev_pop', C, 20)} / {roll('avg', C, 20)}"})))(run(X.bollinger_width))

_lo, _hi = roll("min", "low", 20), roll("max", "high", 20)
query(
    "f10_f12_channel",
    panel_sql(
        r6({
            "slope_sup_20": f"CASE WHEN pos >= 20 THEN regr_slope(sup, pos) {over(20)} END",
            "slope_res_20": f"CASE WHEN pos >= 20 THEN regr_slope(res, pos) {over(20)} END",
            "channel_compression_20": f"(hi - lo) / greatest(abs(close), {TINY})",
            "channel_position_20": f"(close - lo) / greatest(hi - lo, {TINY})",
        }),
        "filled",
        f"c0 AS (SELECT *, {_lo} AS lo, {_hi} AS hi, row_number() {OVER} AS pos FROM bars)",
        "filled AS (SELECT *, coalesce(lo, first_value(lo IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sup, coalesce(hi, first_value(hi IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS res FROM c0)",
    ),
)(run(X.channel))
query(
    "f13_f14_swings",
    panel_sql(
        r6({"dist_to_swing_high_20": f"(close - {_hi}) / greatest(abs(close), {TINY})", "dist_to_swing_low_20": f"(close - {_lo}) / greatest(abs(close), {TINY})"})
        + f", CASE WHEN pos >= 20 THEN CAST(list_position(list_reverse(list(high) {over(20)}), max(high) {over(20)}) - 1 AS INTEGER) END AS days_since_swing_high_20"
        + f", CASE WHEN pos >= 20 THEN CAST(list_position(list_reverse(list(low) {over(20)}), min(low) {over(20)}) - 1 AS INTEGER) END AS days_since_swing_low_20",
        "p0",
        f"p0 AS (SELECT *, row_number() {OVER} AS pos FROM bars)",
    ),
)(run(X.swings))
_fib = {k: f"(sh - {v} * (sh - sl))" for k, v in {"38": 0.382, "50": 0.5, "61": 0.618}.items()}
query(
    "f17_fibonacci",
    panel_sql(
        r6({"swing_high": "sh", "swing_low": "sl", "fib_range": "sh - sl"} | {f"fib_{k}": e for k, e in _fib.items()} | {f"dist_fib_{k}": f"(close - {e}) / nullif(sh - sl, 0)" for k, e in _fib.items()})
        + ", " + ti({"break_fib_61": f"close < {_fib['61']}"}),
        "f0",
        f"f0 AS (SELECT *, {roll('max', 'high', 60)} AS sh, {roll('min', 'low', 60)} AS sl FROM bars)",
    ),
)(run(X.fibonacci))
query(
    "f18_candle_shape",
    panel_sql(
        r6({"body_size": "body_size", "upper_shadow": "upper_shadow", "lower_shadow": "lower_shadow", "high_low_range": "high_low_range", "body_ratio": z("body_size / rng"), "upper_shadow_ratio": z("upper_shadow / rng"), "lower_shadow_ratio": z("lower_shadow / rng"), "close_position": z("(close - low) / rng"), "open_position": z("(open - low) / rng")})
        + ", CAST(sign(close - open) AS TINYINT) AS candle_direction",
        "shape", SHAPE,
    ),
)(run(X.candle_shape))
query("f19_gaps", panel_sql(ti({"gap_up": f"open > {lag_('high')}", "gap_down": f"open < {lag_('low')}"}) + ", " + r6({"gap_size": z(f"open - {lag_(C)}"), "overnight_return": z(f"(open - {lag_(C)}) / {lag_(C)}")})))(run(X.gaps))
query("f20_shape_changes", panel_sql(r6({f"{c}_change": z(f"{c} - {lag_(c)}") for c in ("body_size", "upper_shadow", "lower_shadow")}), "shape", SHAPE))(keep(run(X.candle_shape, X.shape_changes), "body_size_change", "upper_shadow_change", "lower_shadow_change"))
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, {lag_(C)} AS pc FROM bars))"
query(
    "f21_ranges",
    panel_sql(r6({"atr": roll("avg", "tr", 14, 1), "atr_14": roll("avg", "tr", 14, 1), "atr_20": roll("avg", "tr", 20, 1), "rolling_high_low_range_5": f"max(high) {over(5)} - min(low) {over(5)}", "rolling_high_low_range_20": f"max(high) {over(20)} - min(low) {over(20)}"}), "tr", TR),
)(run(X.ranges))
query("f22_percent_sizes", panel_sql(r6({k: z(f"{v} / CASE WHEN abs(close) > {TINY} THEN close END") for k, v in {"body_size_pct": "body_size", "upper_shadow_pct": "upper_shadow", "lower_shadow_pct": "lower_shadow", "range_pct": "high_low_range"}.items()}), "shape", SHAPE))(keep(run(X.candle_shape, X.percent_sizes), "body_size_pct", "upper_shadow_pct", "lower_shadow_pct", "range_pct"))
RET = f"ret AS (SELECT *, close / {lag_(C)} - 1 AS r FROM bars)"
query("f23_returns", panel_sql(r6({f"return_{n}d": z(f"(close - {lag_(C, n)}) / {lag_(C, n)}") for n in (1, 5, 20)})))(run(X.returns))
query("f24_volatility", panel_sql(r6({"rolling_volatility": z(roll("stddev_pop", "r", 20, 1))}), "ret", RET))(run(X.volatility))
LEVELS = f"lv AS (SELECT *, min(low) {over(20)} AS lo, max(high) {over(20)} AS hi FROM bars)"
query("f25_support", panel_sql(r6({"support_distance": "(close - lo) / close", "resistance_distance": "(hi - close) / close"}) + f", CAST(CASE WHEN close > {lag_('hi')} THEN 1 WHEN close < {lag_('lo')} THEN -1 ELSE 0 END AS TINYINT) AS breakout_signal", "lv", LEVELS))(run(X.support))
query("f26_volume", panel_sql(r6({"volume_momentum": f"volume / avg(volume) {over(20)} - 1"}) + ", " + ti({"volume_spike": f"volume > avg(volume) {over(20)} + 2 * stddev_pop(volume) {over(20)}"})))(run(X.volume_signals))
query("f27_lags", panel_sql(r6({f"lag_{n}": z(lag_(C, n)) for n in (1, 3, 5, 10, 20)})))(run(X.close_lags))
query("f28_close_rolling", panel_sql(r6({f"rolling_{k}_{n}": z(f"{f}(close) {over(n)}") for n in (5, 10, 20, 60) for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))}, 5)))(run(X.close_rolling, places=5))
query(
    "f29_shape_rolling",
    panel_sql(
        r6({f"{c}_rolling_{k}_{n}": e for c in ("body_size", "upper_shadow", "lower_shadow") for n in (5, 10, 20, 60) for k, e in (("mean", f"avg({c}) {over(n)}"), ("std", f"stddev_pop({c}) {over(n)}"), ("zscore", z(f"({c} - avg({c}) {over(n)}) / CASE WHEN stddev_pop({c}) {over(n)} > 0 THEN stddev_pop({c}) {over(n)} END")))}, 5),
        "shape", SHAPE,
    ),
)(keep(run(X.candle_shape, X.shape_rolling, places=5), but=("body_size", "upper_shadow", "lower_shadow", "high_low_range", "body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "close_position", "open_position", "candle_direction")))
_b, _b1, _b2 = "br", lag_("br"), lag_("br", 2)
_mid = f"({lag_('open', 2)} + {lag_(C, 2)}) / 2"
_long = "upper_shadow >= 2 * body_size AND lower_shadow <= body_size AND place <= 0.4"
query(
    "f30_patterns",
    panel_sql(
        ti({
            "doji": "br <= 0.1",
            "hammer": "lower_shadow >= 2 * body_size AND upper_shadow <= body_size AND place >= 0.6",
            "inverted_hammer": f"{_long} AND close >= open",
            "shooting_star": f"{_long} AND close <= open",
            "bullish_engulfing": f"{lag_(C)} < {lag_('open')} AND close > open AND open <= {lag_(C)} AND close >= {lag_('open')}",
            "bearish_engulfing": f"{lag_(C)} > {lag_('open')} AND close < open AND open >= {lag_(C)} AND close <= {lag_('open')}",
            "morning_star": f"{lag_(C, 2)} < {lag_('open', 2)} AND {_b2} > 0.5 AND {_b1} <= 0.3 AND close > open AND close >= {_mid}",
            "evening_star": f"{lag_(C, 2)} > {lag_('open', 2)} AND {_b2} > 0.5 AND {_b1} <= 0.3 AND close < open AND close <= {_mid}",
        }),
        "pt", SHAPE, "pt AS (SELECT *, body_size / rng AS br, (close - low) / rng AS place FROM shape)",
    ),
)(keep(run(X.candle_shape, X.patterns), "doji", "hammer", "inverted_hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "morning_star", "evening_star"))

_w = lambda n: (f"max(high) {over(n)}", f"min(low) {over(n)}")
query("f31_distances", panel_sql(r6({k: e for n in (20, 60, 120, 252) for k, e in ((f"distance_to_{n}d_high", f"({_w(n)[0]} - close) / close"), (f"distance_to_{n}d_low", f"(close - {_w(n)[1]}) / close"))})))(run(X.distances))
EXT = "ext AS (SELECT *, " + ", ".join(f"{_w(n)[0]} AS h{n}, {_w(n)[1]} AS l{n}" for n in (20, 60, 120, 252)) + " FROM bars)"
BRK = {k: e for n in (20, 60, 120) for k, e in ((f"breakout_{n}d", f"close > {lag_(f'h{n}')}"), (f"breakdown_{n}d", f"close < {lag_(f'l{n}')}"))}
query("f32_breakouts", panel_sql(ti(BRK), "ext", EXT))(run(X.breakouts))
HL = {"higher_high": f"high > {lag_('high')}", "lower_high": f"high < {lag_('high')}", "higher_low": f"low > {lag_('low')}", "lower_low": f"low < {lag_('low')}"}
SW = f"sw AS (SELECT *, {ti(HL)} FROM ext)"
query("f33_f34_swing_flags", panel_sql(", ".join(HL) + ", " + ", ".join(f"CAST(sum({k}) {over(20)} AS DOUBLE) AS {k}_count_20" for k in HL), "sw", EXT, SW))(run(X.swing_flags))
query("f35_year_extremes", panel_sql(r6({"distance_to_52w_high": "(h252 - close) / close", "distance_to_52w_low": "(close - l252) / close"}) + ", " + ti({"near_52w_high": "(h252 - close) / close <= 0.05", "near_52w_low": "(close - l252) / close <= 0.05"}), "ext", EXT))(run(X.year_extremes))
BR = f"bk AS (SELECT *, {ti(BRK)}, volume / avg(volume) {over(20)} AS vr FROM ext)"
_any = lambda k: f"greatest({k}_20d, {k}_60d, {k}_120d) > 0"
query("f36_volume_confirmation", panel_sql(r6({"breakout_volume_ratio": f"CASE WHEN {_any('breakout')} THEN vr ELSE 0 END", "breakdown_volume_ratio": f"CASE WHEN {_any('breakdown')} THEN vr ELSE 0 END", "volume_spike_ratio": "vr", "volume_momentum": "vr - 1"}), "bk", EXT, BR))(keep(run(X.breakouts, X.volume_confirmation), "breakout_volume_ratio", "breakdown_volume_ratio", "volume_spike_ratio", "volume_momentum"))
query("f37_atr_ratio", panel_sql(r6({"atr_ratio": z(f"{roll('avg', 'tr', 14, 1)} / nullif({roll('avg', 'tr', 20, 1)}, 0)")}), "tr", TR))(keep(run(X.ranges, X.atr_ratio), "atr_ratio"))
query("f38_volatilities", panel_sql(r6({f"rolling_volatility_{n}": z(roll("stddev_pop", "r", n, 1)) for n in (20, 60)}), "ret", RET))(run(lambda d: X.volatility(X.volatility(d, "rolling_volatility_20", 20), "rolling_volatility_60", 60)))
_cnt = lambda k: f"sum({k}) {over(20)}"
TS = f"least(1.0, greatest(-1.0, 0.5 * ({_cnt('higher_high')} + {_cnt('higher_low')} - {_cnt('lower_high')} - {_cnt('lower_low')}) / 20.0 + 0.5 * (2 * coalesce((close - l20) / nullif(h20 - l20, 0), 0.5) - 1)))"
query("f39_trend_strength", panel_sql(r6({"trend_strength_score": TS}), "sw", EXT, SW))(keep(run(X.swing_flags, X.trend_strength), "trend_strength_score"))
query("f40_trend_persistence", panel_sql(r6({f"trend_persistence_{n}": f"avg(s) {over(n)}" for n in (20, 60)}), "sg", f"sg AS (SELECT *, CAST(coalesce(sign(close - {lag_(C)}), 0) AS DOUBLE) AS s FROM bars)"))(run(X.trend_persistence))
_SIG = ("higher_high", "lower_high", "higher_low", "lower_low", "breakout_20d", "breakdown_20d")
query(
    "f41_signal_lags",
    panel_sql(
        ", ".join(f"CAST(coalesce({lag_(s, n)}, 0) AS TINYINT) AS {s}_lag_{n}" for s in _SIG for n in (1, 3, 5, 10, 20)) + ", " + r6({f"trend_strength_score_lag_{n}": z(lag_("ts", n)) for n in (1, 3, 5, 10, 20)}),
        "sl", EXT, f"sx AS (SELECT *, {ti(HL)}, {ti(BRK)} FROM ext)", f"sl AS (SELECT *, {TS} AS ts FROM sx)",
    ),
)(lambda s, d, bars=None: (lambda out: out.select("tic", "date", *(c for c in out.columns if "_lag_" in c)))(run(X.breakouts, X.swing_flags, X.trend_strength, X.signal_lags)(s, d, bars)))
query("f57_amount", panel_sql(r6({"amount": "volume * ((open + high + low + close) / 4)"}, 4)))(run(X.amount, places=4))


def recursive_sql(columns: dict[str, tuple[str, float, int, str]], select: str, source: str = "bars", *steps: str) -> str:
    """columns: name -> (value, alpha, seed row, seed expression over the rows numbered pos)."""
    rows = ", ".join(f"{seed} AS s_{n}, {value} AS v_{n}" for n, (value, _, _, seed) in columns.items())
    first = ", ".join(f"CAST(CASE WHEN pos = {at} THEN s_{n} END AS DOUBLE) AS {n}" for n, (_, _, at, _) in columns.items())
    then = ", ".join(f"CASE WHEN b.pos = {at} THEN b.s_{n} WHEN b.pos > {at} THEN {a!r} * b.v_{n} + (1 - {a!r}) * y.{n} END" for n, (_, a, at, _) in columns.items())
    names = ", ".join(columns)
    from loompanel.plans.adapters import cte

    numbered = f"nb AS (SELECT *, row_number() {OVER} AS pos FROM {source})"
    before = ", ".join([cte("bars"), *steps, numbered, f"rw AS (SELECT *, {rows} FROM nb)"])
    return f"WITH RECURSIVE {before}, y(tic, pos, {names}) AS (SELECT tic, pos, {first} FROM rw WHERE pos = 1 UNION ALL SELECT b.tic, b.pos, {then} FROM y JOIN rw b ON b.tic = y.tic AND b.pos = y.pos + 1), out AS (SELECT rw.*, {', '.join(f'y.{n}' for n in columns)} FROM rw JOIN y ON rw.tic = y.tic AND rw.pos = y.pos) SELECT tic, date, {select} FROM out"


query("f03_ema", recursive_sql({f"e{p}": (C, 2 / (p + 1), p, f"avg(close) {over(p)}") for p in (50, 200)}, r6({"ema_50": "e50", "ema_200": "e200"}, 5)))(run(lambda x: R.ema(R.ema(x, 50), 200), places=5))
CHG = f"ch AS (SELECT *, greatest(close - {lag_(C)}, 0) AS up, greatest({lag_(C)} - close, 0) AS dn FROM bars)"
_RSI = {n: (n[1:], 1 / 7, 8, f"avg({n[1:]}) {over(7)}") for n in ("wup", "wdn")}
query("f04_rsi", recursive_sql(_RSI, r6({"rsi_7": "CASE WHEN wup IS NOT NULL THEN coalesce(wup / nullif(wup + wdn, 0), 0) END"}), "ch", CHG))(run(R.rsi))
_x = "CASE WHEN wup IS NOT NULL THEN coalesce(wup / nullif(wup + wdn, 0), 0) END"
query(
    "f05_stochrsi",
    recursive_sql(_RSI, "rsi, pos", "ch", CHG).replace("SELECT tic, date, rsi, pos FROM out", f", q AS (SELECT *, {_x} AS x FROM out) SELECT tic, date, " + r6({"stochrsi_7": f"CASE WHEN count(x) {over(16)} >= 16 THEN coalesce((x - min(x) {over(14)}) / nullif(max(x) {over(14)} - min(x) {over(14)}, 0), 0) END"}, 5) + " FROM q"),
)(run(R.stoch_rsi, places=5))
_MACD = {"ef": (C, 2 / 13, 26, f"avg(close) {over(12)}"), "es": (C, 2 / 27, 26, f"avg(close) {over(26)}")}
query(
    "f06_macd",
    recursive_sql(_MACD, "XX").replace(
        "SELECT tic, date, XX FROM out",
        f", m AS (SELECT tic, date, pos, ef - es AS m FROM out), m2 AS (SELECT *, avg(m) {over(9)} AS seed FROM m), g(tic, pos, sig) AS (SELECT tic, pos, seed FROM m2 WHERE pos = 34 UNION ALL SELECT m2.tic, m2.pos, 0.2 * m2.m + 0.8 * g.sig FROM g JOIN m2 ON m2.tic = g.tic AND m2.pos = g.pos + 1) SELECT m.tic, m.date, " + r6({"macd": "CASE WHEN g.sig IS NOT NULL THEN m.m END", "macd_signal": "g.sig", "macd_hist": "m.m - g.sig"}, 5) + " FROM m LEFT JOIN g ON m.tic = g.tic AND m.pos = g.pos",
    ),
)(run(R.macd, places=5))
query("f07_atr_norm", recursive_sql({"a": ("tr", 1 / 14, 15, f"avg(tr) {over(14)}")}, r6({"atr_14_norm": "a / nullif(close, 0)"}), "tr", TR))(run(R.atr_norm))
query("f20_w04_smoothed_bodies", recursive_sql({f"e{p}": ("body_size", 2 / (p + 1), 1, "body_size") for p in (5, 20)}, r6({"body_size_ema_5": "e5", "body_size_ema_20": "e20"}, 5), "shape", SHAPE))(keep(run(X.candle_shape, R.smoothed_bodies, places=5), "body_size_ema_5", "body_size_ema_20"))
