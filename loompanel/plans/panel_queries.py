"""Queries of joins, preparation, samples and evaluation over the adapter panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loompanel.functions.columns import P as PANEL
from loompanel.functions.columns import rounded, row_mean
from loompanel.operators import analyse as A
from loompanel.operators import evaluate as E
from loompanel.operators import features as X
from loompanel.operators import joins as J
from loompanel.operators import prepare as P
from loompanel.operators import sampling as G
from loompanel.operators import samples as S
from loompanel.operators import sector as C
from loompanel.operators import trendlines as L
from loompanel.plans.adapters import cte, table, view
from loompanel.plans.pipelines import Settings, add_all_features, preprocess
from loompanel.plans.registry import ORACLES, OVER, QUERIES, lag_, over, query, r6, roll
from loompanel.sources import ingest as I
from loompanel.sources import sinks as K


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bars")


def kept(spark: SparkSession, sf_dir: str, *columns: str, name: str = "bars") -> DataFrame:
    """A panel (or some of its columns) made once and written, for queries that read it more than once: every
    reading would join and group the whole of ``lineitem`` again, and a panel is one row for each ticker and date."""
    return K.materialise(view(spark, sf_dir, name, *columns), name)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A momentum model: prediction is minus the return of the last bar in percent."""
    return momentum(bars(spark, sf_dir))


def momentum(panel: DataFrame) -> DataFrame:
    df = P.target(X.returns(panel), 5)
    return df.select("tic", "grp", "date", F.round(-F.col("return_1d") * 100 + 0.00000031, 6).alias("prediction"), F.round(F.col("target") + 0.00000031, 6).alias("target"))


def kept_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, made once, for queries that read them more than once."""
    return K.materialise(predictions(spark, sf_dir), "predictions")


PRED = f"""pred AS (SELECT tic, grp, date, round(-coalesce((close - p) / p, 0) * 100 + 0.00000031, 6) AS prediction, round((f - close) / close * 100 + 0.00000031, 6) AS target
FROM (SELECT *, {lag_('close')} AS p, lead(close, 5) {OVER} AS f FROM bars) WHERE f IS NOT NULL)"""
HIT = "CASE WHEN sign(prediction) = sign(target) THEN 1 ELSE 0 END"


def pred_sql(select: str, tail: str = "", *steps: str) -> str:
    return f"WITH {', '.join([cte('bars'), PRED, *steps])} SELECT {select} {tail or 'FROM pred'}"


def q(name: str, sql: str | None, f, places: int = 6):
    query(name, sql)(lambda s, d: rounded(f(s, d), places))


# ---- sources, sinks, validation -------------------------------------------------------------------
#: Members of one index document at most.
INDEX_BLOCK = 500


def json_index(s: SparkSession, d: str) -> DataFrame:
    """The customers as index documents, one for each region and block of keys, to be parsed again."""
    places = table(s, d, "nation").join(table(s, d, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = table(s, d, "customer").join(places, F.expr("c_nationkey = n_nationkey"))
    member = F.struct(
        F.col("c_name").alias("Code"), F.lower("c_name").alias("Name"), F.col("r_name").alias("Sector"),
        F.concat(F.lit("I"), (F.col("c_custkey") % 3).cast("string")).alias("Industry"), (F.col("c_custkey") * 2).cast("string").alias("Weight"),
    )
    entry = F.struct(F.col("c_custkey").alias("k"), member.alias("member"))
    docs = rows.groupBy("r_name", F.floor(F.col("c_custkey") / INDEX_BLOCK)).agg(F.array_sort(F.collect_list(entry)).alias("m"))
    members = F.map_from_entries(F.transform("m", lambda e: F.struct(e["k"].cast("string"), e["member"])))
    return docs.select(F.to_json(F.struct(members.alias("Components"))).alias("value"))


IDX = f"""idx AS (SELECT c_name AS code, lower(c_name) AS name, r_name AS sector, 'I' || (c_custkey % 3) AS industry, CAST(c_custkey * 2 AS DOUBLE) AS weight,
row_number() OVER (PARTITION BY r_name, c_custkey // {INDEX_BLOCK} ORDER BY c_custkey) - 1 AS pos
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
q("a07_constituents", f"WITH {IDX} SELECT code, name, sector, industry, weight, CAST(pos AS INTEGER) AS pos FROM idx", lambda s, d: I.constituents(json_index(s, d)))
q("a08_first_codes", f"WITH {IDX} SELECT code FROM idx ORDER BY pos, code LIMIT 7", lambda s, d: I.first_codes(I.constituents(json_index(s, d)), 7))
q(
    "a09_filter_constituents",
    f"WITH {IDX} SELECT code, weight FROM idx WHERE industry IN ('I0', 'I1') AND code <> 'Customer#000000003' AND weight >= 8 AND sector <> 'ASIA'",
    lambda s, d: I.filter_constituents(I.constituents(json_index(s, d)), exclude=["Customer#000000003"], sectors=["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"], industries=["I0", "I1"], min_weight=8.0).select("code", "weight"),
)
q("a01_a03_standardise_union", f"WITH {cte('bars')} SELECT tic, date, {r6({c: c for c in ('open', 'high', 'low', 'close', 'volume')})} FROM bars", lambda s, d: I.union_panels([I.standardise_bars(bars(s, d).where("grp < 'AMF'")), I.standardise_bars(bars(s, d).where("grp >= 'AMF'").withColumnRenamed("close", "Adj Close").withColumn("close", F.lit(0.0)))]))
q("a04_mean_series", f"WITH {cte('bars')} SELECT tic, date, {r6({'m': '(open + high + low + close) / 4'})} FROM bars", lambda s, d: bars(s, d).select("tic", "date", row_mean("open", "high", "low", "close").alias("m")))
q("a05_yield_mean", f"WITH {cte('yields')} SELECT date, {r6({'bondyield': '(y2 + y10 + y30) / 3'})} FROM yields", lambda s, d: I.mean_series(view(s, d, "yields"), "bondyield", ("y2", "y10", "y30")))
q("a06_merge_series", f"WITH {cte('vix', 'yields')} SELECT coalesce(v.date, y.date) AS date, {r6({'vix': 'vix', 'y2': 'y2'})} FROM vix v FULL JOIN yields y ON v.date = y.date", lambda s, d: I.merge_series([view(s, d, "vix"), view(s, d, "yields").select("date", "y2")]))
#: All part types of the adapter's commodity panel.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
q(
    "a06_pivot_series",
    f"WITH {cte('commodity')} SELECT date, {r6({t.lower(): f'max(CASE WHEN name = $${t}$$ THEN price END)' for t in TYPES})} FROM commodity GROUP BY date",
    lambda s, d: I.pivot_series(view(s, d, "commodity"), list(TYPES)).select("date", *(F.col(t).alias(t.lower()) for t in TYPES)),
)


def documents_of_tickers(s, d):
    """Fundamentals documents made of the statements, to be parsed again."""
    st, hl = view(s, d, "statements"), view(s, d, "highlights")
    text = F.struct(*(F.col(c).cast("string").alias(c) for c in I.STATEMENT))
    quarters = st.groupBy("tic").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), text))).alias("quarterly"))
    doc = quarters.join(hl, "tic").select("tic", F.to_json(F.struct(F.struct(F.col("market_cap").cast("string").alias("MarketCap"), F.when(F.col("market_cap") > 0, (F.col("market_cap") / 1000).cast("string")).otherwise("n/a").alias("PERatio"), F.when(F.length("tic") % 2 == 0, (F.length("tic") / 4.0).cast("string")).alias("PEGRatio"), (F.col("dividend_yield") * -2).cast("string").alias("DilutedEpsTTM"), F.when(F.length("tic") % 3 > 0, F.col("dividend_yield").cast("string")).alias("DividendYield"), (F.length("tic") - 6).cast("string").alias("DividendShare")).alias("Highlights"), F.struct(F.struct("quarterly").alias("Balance_Sheet"), F.struct("quarterly").alias("Income_Statement")).alias("Financials"))).alias("value"))
    return doc.select("tic", F.from_json("value", I.FUNDAMENTALS).alias("doc"))


q("a10_j03_statements", f"WITH {cte('statements')} SELECT tic, date, {', '.join(f'round({c} + 0.0031, 2) AS {c}' for c in I.STATEMENT)} FROM statements", lambda s, d: I.statements(documents_of_tickers(s, d)), 2)
q("a11_market_cap", f"WITH {cte('highlights')} SELECT tic, round(nullif(market_cap, 0) + 0.0031, 2) AS market_cap FROM highlights", lambda s, d: I.market_caps(documents_of_tickers(s, d)), 2)
_PAYS = "(length(tic) % 3 > 0 AND dividend_yield > 0) OR (CASE WHEN length(tic) % 3 > 0 THEN dividend_yield = 0 ELSE true END AND length(tic) > 6)"
q(
    "f53_highlights",
    f"WITH {cte('highlights')} SELECT tic, {r6({'pe_ratio': 'CASE WHEN market_cap > 0 THEN market_cap / 1000 END', 'peg_ratio': 'CASE WHEN length(tic) % 2 = 0 THEN length(tic) / 4.0::DOUBLE END', 'eps': '-2 * dividend_yield'})}, CAST(CASE WHEN {_PAYS} THEN 1 ELSE 2 END AS TINYINT) AS dividend_flag FROM highlights",
    lambda s, d: I.highlights(documents_of_tickers(s, d)),
)
RATIO = {"roe": "netIncome / nullif(totalStockholderEquity, 0)", "roi": "netIncome / nullif(totalAssets, 0)", "debt_to_equity": "totalLiab / nullif(totalStockholderEquity, 0)", "debt_to_asset": "totalLiab / nullif(totalAssets, 0)", "current_ratio": "totalCurrentAssets / nullif(totalCurrentLiabilities, 0)"}
RAT = "rat AS (SELECT tic, date, " + ", ".join(f"{e} AS {k}" for k, e in RATIO.items()) + " FROM statements)"
q("f54_ratios", f"WITH {cte('statements')}, {RAT} SELECT tic, date, {r6({k: k for k in RATIO})} FROM rat", lambda s, d: J.ratios(view(s, d, "statements")))
ASOF = ", ".join(f"(SELECT max_by(r.{k}, r.date) FROM rat r WHERE r.tic = b.tic AND r.date >= b.f AND r.date <= b.date AND r.{k} IS NOT NULL) AS {k}" for k in RATIO)
FB = "fb AS (SELECT tic, date, min(date) OVER (PARTITION BY tic) AS f FROM bars)"
q("j04_as_of", f"WITH {cte('bars', 'statements')}, {RAT}, {FB}, o AS (SELECT tic, date, {ASOF} FROM fb b) SELECT tic, date, {r6({k: k for k in RATIO})} FROM o", lambda s, d: J.as_of(bars(s, d), J.ratios(view(s, d, "statements")), list(RATIO)))
q("j05_interpolate", f"WITH {cte('bars', 'statements')}, {RAT}, {FB}, k AS (SELECT r.tic, r.date, r.roi FROM rat r JOIN (SELECT DISTINCT tic, f FROM fb) x ON r.tic = x.tic AND r.date >= x.f WHERE roi IS NOT NULL), o AS (SELECT b.tic, b.date, p.date AS da, p.roi AS a, n.date AS db, n.roi AS b FROM fb b ASOF LEFT JOIN k p ON b.tic = p.tic AND b.date >= p.date ASOF LEFT JOIN k n ON b.tic = n.tic AND b.date < n.date) SELECT tic, date, {r6({'roi': 'CASE WHEN b IS NULL OR a IS NULL THEN a ELSE a + (b - a) * (date - da) / CAST(db - da AS DOUBLE) END'})} FROM o", lambda s, d: J.interpolate(bars(s, d), J.ratios(view(s, d, "statements")).select("tic", "date", "roi"), ["roi"]))
q(
    "f55_daily_fundamentals",
    f"WITH {cte('bars', 'statements', 'highlights')}, {RAT}, {FB}, o AS (SELECT tic, date, {ASOF} FROM fb b) SELECT o.tic, o.date, {r6({k: k for k in (*RATIO, 'market_cap', 'dividend_yield')})} FROM o LEFT JOIN highlights h ON o.tic = h.tic",
    lambda s, d: J.daily_fundamentals(bars(s, d), J.ratios(view(s, d, "statements")), view(s, d, "highlights").select("tic", "market_cap", "dividend_yield")),
)
q("f56_inference_defaults", f"WITH {cte('statements')}, {RAT} SELECT tic, date, {r6({k: k for k in RATIO} | {'pe_ratio': '0.0', 'peg_ratio': '0.0', 'eps': '0.0'})}, CAST(2 AS TINYINT) AS dividend_flag FROM rat", lambda s, d: J.inference_defaults(J.ratios(view(s, d, "statements"))))
q(
    "j01_macro_merge",
    f"WITH {cte('bars', 'vix', 'yields', 'commodity')}, cm AS (SELECT date, {', '.join(f'max(CASE WHEN name = $${t}$$ THEN price END) AS {t.lower()}' for t in TYPES)} FROM commodity GROUP BY date) "
    f"SELECT tic, b.date, {r6({c: c for c in ('close', 'vix', 'y2', 'y10', 'y30', *map(str.lower, TYPES))})} FROM bars b LEFT JOIN vix v ON b.date = v.date LEFT JOIN yields y ON b.date = y.date LEFT JOIN cm ON b.date = cm.date",
    lambda s, d: J.merge_macro(bars(s, d), view(s, d, "vix"), I.pivot_series(view(s, d, "commodity"), list(TYPES)).withColumnsRenamed({t: t.lower() for t in TYPES}), view(s, d, "yields")).select("tic", "date", "close", "vix", "y2", "y10", "y30", *map(str.lower, TYPES)),
)
q("j06_date_grid", f"WITH {cte('bars')} SELECT tic, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars GROUP BY tic", lambda s, d: J.date_grid(bars(s, d)))
q("j07_sector_pairs", f"WITH {cte('bars')} SELECT a.tic, b.tic AS peer, count(*) AS n, round(max(a.close - b.close) + 0.00000031, 6) AS gap FROM bars a JOIN bars b ON a.grp = b.grp AND a.date = b.date AND a.tic <> b.tic GROUP BY a.tic, b.tic", lambda s, d: J.same_sector_pairs(kept(s, d, "tic", "grp", "date", "close")).groupBy("tic", "peer").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("y") - F.col("x")).alias("gap")))
q("j08_j09_realign", f"WITH {cte('bars')} SELECT tic, date, {r6({'close': 'close / 10', 'raw_close': 'close'})} FROM bars", lambda s, d: (lambda x: J.realign(x.select("tic", "date", (F.col("close") / 10).alias("close")), x, ("tic", "date")))(kept(s, d, "tic", "date", "close")))
q("a21_failure_ledger", "WITH e AS (SELECT 'T' || (user_id % 50) AS tic, event_type AS reason, ts AS tm FROM events) SELECT tic, min_by(reason, (tm, reason)) AS first_reason, max_by(reason, (tm, reason)) AS last_reason, CAST(count(*) AS BIGINT) AS attempts FROM e GROUP BY tic", lambda s, d: (lambda ev: K.failure_upsert(K.failure_upsert(s.createDataFrame([], "tic string, first_reason string, last_reason string, first_at timestamp_ntz, last_at timestamp_ntz, attempts bigint").select("tic", "first_reason", "last_reason", F.col("first_at").cast(dict(ev.dtypes)["at"]), F.col("last_at").cast(dict(ev.dtypes)["at"]), "attempts"), ev.where("tic < 'T3'")), ev.where("tic >= 'T3'")).drop("first_at", "last_at"))(table(s, d, "events").select(F.concat(F.lit("T"), (F.col("user_id") % 50).cast("string")).alias("tic"), F.col("event_type").alias("reason"), F.col("ts").alias("at"))))
q("a22_one_removed", "WITH e AS (SELECT user_id, max_by(event_type, (ts, event_type)) AS last_reason, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id) SELECT 'T' || user_id AS tic, last_reason, first_at, last_at FROM e WHERE user_id <> 3", lambda s, d: K.failure_removed(ledger(s, d), "T3"))
q("a22_without_failed", f"WITH {cte('highlights')} SELECT tic FROM highlights WHERE tic NOT IN (SELECT tic FROM highlights WHERE dividend_yield < -0.9)", lambda s, d: K.without_failed(view(s, d, "highlights").select("tic"), view(s, d, "highlights").where("dividend_yield < -0.9")))
q("a24_named_ids", "SELECT c_custkey, CASE WHEN n_nationkey < 20 THEN n_name ELSE 'stock_' || c_nationkey END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda s, d: E.named_ids(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("id")), table(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "id", "name", "stock_").select("c_custkey", "name"))
q("v04_non_finite", f"WITH {cte('bars')}, x AS (SELECT CASE WHEN volume < 5 THEN 'NaN'::DOUBLE WHEN volume > 90 THEN 'inf'::DOUBLE ELSE close END AS x FROM bars) SELECT 'x' AS feature, count(*) FILTER (WHERE isnan(x)) AS nan, count(*) FILTER (WHERE x = 'inf') AS pos_inf, CAST(0 AS BIGINT) AS neg_inf, CAST(0 AS BIGINT) AS nulls FROM x", lambda s, d: A.non_finite(bars(s, d).select(F.when(F.col("volume") < 5, float("nan")).when(F.col("volume") > 90, float("inf")).otherwise(F.col("close")).alias("x")), ["x"]))
_HOLES = {"open": "CASE WHEN volume >= 5 THEN open END", "high": "high", "low": "CASE WHEN volume < 60 THEN low END", "close": "close", "volume": "CASE WHEN volume <> 7 THEN volume END"}


def bars_with_holes(s: SparkSession, d: str) -> DataFrame:
    df = bars(s, d).selectExpr("tic", "date", *(f"{e} AS {c}" for c, e in _HOLES.items()))
    A.ohlcv_contract(df)
    return A.null_counts(df)


q("v03_null_counts", f"WITH {cte('bars')} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({e}) AS nulls, count(*) AS rows FROM bars" for c, e in _HOLES.items()), bars_with_holes)
q("v05_sanitise", f"WITH {cte('bars')} SELECT tic, date, {r6({'x': 'CASE WHEN volume < 5 THEN 0 ELSE close END'})} FROM bars", lambda s, d: A.sanitise(bars(s, d).select("tic", "date", F.when(F.col("volume") < 5, float("nan")).otherwise(F.col("close")).alias("x")), ["x"]))

# ---- sector features ------------------------------------------------------------------------------
LOO = "CASE WHEN count({c}) OVER w > 1 THEN (sum(CAST(round({c} * 1000000) AS BIGINT)) OVER w - CAST(round({c} * 1000000) AS BIGINT)) / 1000000.0::DOUBLE / (count({c}) OVER w - 1) END"
REL = f"r0 AS (SELECT *, (close - {lag_('close')}) / {lag_('close')} AS ret FROM bars), r1 AS (SELECT *, {LOO.format(c='close')} AS pc, {LOO.format(c='ret')} AS pr FROM r0 WINDOW w AS (PARTITION BY grp, date)), r2 AS (SELECT *, (close - pc) / nullif(abs(pc), 0) AS rel FROM r1)"
RELATIVE = ("stock_return_1d", "relative_price_vs_sector", "relative_return_vs_sector", "relative_price_vs_sector_norm")
Z60 = f"(rel - {roll('avg', 'rel', 60)}) / nullif({roll('stddev_pop', 'rel', 60)}, 0)"
q("g01_f43_f45_relative", f"WITH {cte('bars')}, {REL} SELECT tic, date, {r6({'stock_return_1d': 'ret', 'relative_price_vs_sector': 'rel', 'relative_return_vs_sector': 'ret - pr', 'relative_price_vs_sector_norm': Z60}, 5)} FROM r2", lambda s, d: C.relative(bars(s, d)).select("tic", "date", *RELATIVE), 5)
#: Windows of the pair queries: of days, which a nation has no year of without a gap, and of weeks, which it has.
PW, WEEKS = 12, 252


def pair_sql(base: str, window: int) -> str:
    po = over(window, "grp, tic, peer")
    return f"""dd AS (SELECT DISTINCT grp, date FROM {base}), tt AS (SELECT DISTINCT grp, tic FROM {base}),
gr AS (SELECT dd.grp, dd.date, tt.tic, b.close FROM dd JOIN tt USING (grp) LEFT JOIN {base} b ON b.tic = tt.tic AND b.date = dd.date),
g2 AS (SELECT *, (close - lag(close) {OVER}) / nullif(lag(close) {OVER}, 0) AS r FROM gr),
pp AS (SELECT a.grp, a.date, a.tic, b.tic AS peer, a.close AS y, b.close AS x, CASE WHEN b.r IS NOT NULL THEN a.r END AS ry, CASE WHEN a.r IS NOT NULL THEN b.r END AS rx FROM g2 a JOIN g2 b ON a.grp = b.grp AND a.date = b.date AND a.tic <> b.tic),
pw AS (SELECT grp, date, tic, peer, y, x, count(y) {po} AS ny, count(x) {po} AS nx, count(ry) {po} AS n, abs(corr(ry, rx) {po}) AS c, regr_slope(y, x) {po} AS beta, avg(y) {po} AS my, avg(x) {po} AS mx, var_pop(y) {po} AS vy, var_pop(x) {po} AS vx, covar_pop(y, x) {po} AS cxy FROM pp),
pk AS (SELECT *, row_number() OVER (PARTITION BY grp, tic, date ORDER BY c DESC, peer) AS rk FROM pw WHERE ny = {window} AND nx = {window} AND n >= 10 AND c IS NOT NULL AND NOT isnan(c)),
pq AS (SELECT *, y - beta * x AS s, my - beta * mx AS m, sqrt(greatest(vy - 2 * beta * cxy + beta * beta * vx, 0)) AS sd FROM pk WHERE rk = 1 AND vx > 0)"""


SPREADS = ("pair_beta", "spread", "rolling_mean_spread", "rolling_std_spread", "spread_zscore")
SPREAD_SQL = {"pair_beta": "beta", "spread": "s", "rolling_mean_spread": "m", "rolling_std_spread": "nullif(sd, 0)", "spread_zscore": "(s - m) / nullif(sd, 0)"}


def daily_pairs(s: SparkSession, d: str) -> DataFrame:
    return C.spreads(kept(s, d, "tic", "grp", "date", "close"), PW).select("tic", "date", "peer", *SPREADS)


def weekly_pairs(s: SparkSession, d: str) -> DataFrame:
    return C.spreads(kept(s, d, name="weeks"), WEEKS).select("tic", "date", "peer", *SPREADS)


def weekly_tests(s: SparkSession, d: str) -> DataFrame:
    weeks = kept(s, d, name="weeks")
    return C.spread_adf(weeks, C.spreads(weeks, WEEKS), WEEKS).select("tic", "date", "spread_norm", "spread_adf_stat", "spread_adf_pvalue")


q("f46_f47_pairs", f"WITH {cte('bars')}, {pair_sql('bars', PW)} SELECT tic, date, peer, {r6(SPREAD_SQL, 4)} FROM pq", daily_pairs, 4)
q("f46_f47_pairs_of_weeks", f"WITH {cte('weeks')}, {pair_sql('weeks', WEEKS)} SELECT tic, date, peer, {r6(SPREAD_SQL, 4)} FROM pq", weekly_pairs, 4)
q("f48_f49_spread_adf", None, lambda s, d: (lambda x: C.spread_adf(x, C.spreads(x, PW, 20), PW).select("tic", "date", "spread_norm", "spread_adf_stat", "spread_adf_pvalue"))(kept(s, d, "tic", "grp", "date", "close")))
q("f48_f49_spread_adf_of_weeks", None, weekly_tests)
q("f50_f52_equilibrium", None, lambda s, d: C.equilibrium(kept(s, d, "tic", "grp", "date", "close"), 30, 20))
q("f50_f52_equilibrium_of_weeks", None, lambda s, d: C.equilibrium(kept(s, d, name="weeks"), WEEKS))
q("f15_f16_trendlines", None, lambda s, d: L.trendlines(bars(s, d).select("tic", "date", "high", "low", "close")).drop("high", "low", "close"))

# ---- targets, splits, folds, encodings, scalers ---------------------------------------------------
TGT = f"tg AS (SELECT *, (f - close) / close * 100 AS target FROM (SELECT *, lead(close, 5) {OVER} AS f FROM bars) WHERE f IS NOT NULL)"
q("t01_target", f"WITH {cte('bars')}, {TGT} SELECT tic, date, {r6({'target': 'target'})} FROM tg", lambda s, d: P.target(bars(s, d)).select("tic", "date", "target"))
q("t02_t03_squash", f"WITH {cte('bars')}, {TGT} SELECT tic, date, {r6({'target': 'tanh(target / 100)', 'back': '100 * atanh(greatest(-0.99, least(0.99, tanh(target / 100))))'})} FROM tg", lambda s, d: P.target(bars(s, d), 5, 100.0).select("tic", "date", "target", P.unsquashed(F.col("target"), 100.0).alias("back")))
DATES = "dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pl, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
SPL = "sp AS (SELECT date, CASE WHEN pl < CAST(floor(n * 0.7::DOUBLE) AS INT) THEN 'train' WHEN pl < CAST(floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) AS INT) THEN 'val' ELSE 'test' END AS split FROM dt)"
q("p01_date_split", f"WITH {cte('bars')}, {DATES}, {SPL} SELECT tic, date, split FROM bars JOIN sp USING (date)", lambda s, d: P.date_split(kept(s, d, "tic", "date")).select("tic", "date", "split"))
q("v06_split_overlap", f"WITH {cte('bars')}, {DATES}, {SPL} SELECT date, count(DISTINCT split) AS splits FROM (SELECT date, split FROM sp UNION ALL SELECT date, 'x' FROM sp WHERE split = 'val') GROUP BY date HAVING count(DISTINCT split) > 1", lambda s, d: (lambda x: A.split_overlap(x.union(x.where("split = 'val'").withColumn("split", F.lit("x")))))(P.date_split(kept(s, d, "tic", "date")).select("date", "split")))
q("p02_walk_forward", f"WITH {cte('bars')}, {DATES}, fo AS (SELECT unnest(generate_series(0, 100)) AS fold), rg AS (SELECT CAST(fold AS INTEGER) AS fold, 'train' AS role, fold * 200 AS a, fold * 200 + 300 AS b FROM fo UNION ALL SELECT fold, 'val', fold * 200 + 305, fold * 200 + 405 FROM fo) SELECT fold, role, tic, date FROM bars JOIN dt USING (date) JOIN rg ON pl >= a AND pl < b WHERE fold * 200 + 405 <= n", lambda s, d: P.walk_forward(kept(s, d, "tic", "date"), 300, 5, 100, 200).select("fold", "role", "tic", "date"))
PF = "pf AS (SELECT CAST(i AS INTEGER) AS fold, 300 + i * ((n - 305) // 4) AS e, (n - 305) // 4 AS sz, n FROM (SELECT max(n) AS n FROM dt), (SELECT unnest(generate_series(0, 3)) AS i)), rg AS (SELECT fold, 'train' AS role, 0 AS a, e AS b FROM pf UNION ALL SELECT fold, 'val', e + 5, CASE WHEN fold = 3 THEN n ELSE e + 5 + sz END FROM pf)"
q("p03_p04_purged_folds", f"WITH {cte('bars')}, {DATES}, {PF} SELECT fold, role, min(date) AS first, max(date) AS last FROM bars JOIN dt USING (date) JOIN rg ON pl >= a AND pl < b GROUP BY fold, role", lambda s, d: P.fold_bounds(P.purged_folds(kept(s, d, "tic", "date"), 4, 5, 300)))
q("e01_encode", f"WITH {cte('bars')}, ids AS (SELECT tic, row_number() OVER (ORDER BY tic) - 1 AS i FROM (SELECT DISTINCT tic FROM bars WHERE grp < 'B')) SELECT tic, date, CAST(coalesce(i, -1) AS INTEGER) AS tic_id FROM bars LEFT JOIN ids USING (tic)", lambda s, d: (lambda x: P.encode(x, P.label_ids(x.where("grp < 'B'"), "tic"), "tic", "tic_id").select("tic", "date", "tic_id"))(kept(s, d, "tic", "grp", "date")))
q("e02_extend_ids", f"WITH {cte('bars')}, ids AS (SELECT tic, row_number() OVER (ORDER BY tic) - 1 AS id FROM (SELECT DISTINCT tic FROM bars WHERE grp < 'B')), nw AS (SELECT tic, row_number() OVER (ORDER BY min(date), tic) + (SELECT max(id) FROM ids) AS id FROM bars WHERE tic NOT IN (SELECT tic FROM ids) GROUP BY tic) SELECT tic, CAST(id AS INTEGER) AS id FROM ids UNION ALL SELECT tic, CAST(id AS INTEGER) FROM nw", lambda s, d: (lambda x: P.extend_ids(P.label_ids(x.where("grp < 'B'"), "tic"), x, "tic"))(kept(s, d, "tic", "grp", "date")))
q("b02_trailing_years", f"WITH {cte('bars')} SELECT tic, date FROM bars WHERE date >= (SELECT max(date) FROM bars) - 730", lambda s, d: P.trailing_years(kept(s, d, "tic", "date"), 2).select("tic", "date"))
q("b01_by_tickers", f"WITH {cte('bars')} SELECT tic, date FROM bars WHERE tic IN ('NATION_1', 'NATION_4')", lambda s, d: P.by_tickers(bars(s, d), ["NATION_1", "NATION_4"]).select("tic", "date"))
q("b03_sectors", f"WITH {cte('bars')} SELECT tic, date, CASE WHEN grp < 'B' THEN grp ELSE 'Unknown' END AS \"group\" FROM bars", lambda s, d: (lambda x: P.sectors(x, x.where("grp < 'B'").select("tic", F.col("grp").alias("sector")).distinct()).select("tic", "date", "group"))(kept(s, d, "tic", "grp", "date")))
REG = "ml AS (SELECT b.tic, b.date, vix, split FROM bars b LEFT JOIN vix v ON b.date = v.date JOIN sp ON b.date = sp.date), cu AS (SELECT quantile_cont(vix, 1.0 / 3) AS a, quantile_cont(vix, 2.0 / 3) AS b FROM ml WHERE split = 'train')"


def with_vix(s, d):
    return P.date_split(J.merge_macro(kept(s, d, "tic", "date"), view(s, d, "vix")))


q("r01_r02_regime", f"WITH {cte('bars', 'vix')}, {DATES}, {SPL}, {REG} SELECT tic, date, CAST(CASE WHEN vix IS NULL THEN 1 WHEN vix >= b THEN 2 WHEN vix >= a THEN 1 ELSE 0 END AS INTEGER) AS regime_id FROM ml, cu", lambda s, d: (lambda x: P.regime(x, "vix", P.fit_regime(x, "vix")).select("tic", "date", "regime_id"))(with_vix(s, d)))
q("r03_regime_params", f"WITH {cte('bars', 'vix')}, {DATES}, {SPL}, {REG} SELECT 'vix' AS \"column\", 'cut_0' AS stat, round(a + 0.00000031, 6) AS value FROM cu UNION ALL SELECT 'vix', 'cut_1', round(b + 0.00000031, 6) FROM cu UNION ALL SELECT 'vix', 'default', round(1.00000031, 6)", lambda s, d: P.regime_params(s, "vix", P.fit_regime(with_vix(s, d), "vix")))
q("n01_fill", f"WITH {cte('bars', 'vix')} SELECT tic, b.date, {r6({'vix': 'coalesce(vix, 0)'})} FROM bars b LEFT JOIN vix v ON b.date = v.date", lambda s, d: P.fill_numbers(J.merge_macro(bars(s, d), view(s, d, "vix")), ["vix"]).select("tic", "date", "vix"))
for _n, _m, _a, _b, _inf in (("n03_standard", "standard", "avg({c})", "stddev_pop({c})", False), ("n04_minmax", "minmax", "min({c})", "max({c}) - min({c})", False), ("n05_robust", "robust", "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", False), ("n06_inference", "robust", "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) + 1e-8", True)):
    _st = ", ".join(f"{_a.format(c=c)} AS {c}_a, {_b.format(c=c)} AS {c}_b" for c in ("close", "volume"))
    q(_n, f"WITH {cte('bars')}, {DATES}, {SPL}, st AS (SELECT {_st} FROM bars JOIN sp USING (date) WHERE split = 'train') SELECT tic, date, {r6({c: f'({c} - {c}_a) / {c}_b' for c in ('close', 'volume')}, 5)} FROM bars, st", lambda s, d, m=_m, i=_inf: (lambda x: P.scale(x, P.fit_scaler(x, ["close", "volume"], m), m, i).select("tic", "date", "close", "volume"))(P.date_split(kept(s, d, "tic", "date", "close", "volume"))), 5)
q("n02_log", f"WITH {cte('bars')}, {DATES}, {SPL}, st AS (SELECT min(close) AS m FROM bars JOIN sp USING (date) WHERE split = 'train') SELECT tic, date, {r6({'close': 'ln(1 + greatest(close - m + 1, 0))'})} FROM bars, st", lambda s, d: (lambda x: P.scale(x, P.fit_scaler(x, ["close"], "log"), "log").select("tic", "date", "close"))(P.date_split(kept(s, d, "tic", "date", "close"))))
q("n10_inverse", f"WITH {cte('bars')}, p AS (SELECT close AS y, (close - 500) / 37 AS x FROM bars), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p) SELECT 'affine' AS kind, round(a + 0.0031, 2) AS a, round(b + 0.0031, 2) AS b FROM f", lambda s, d: P.fit_inverse(kept(s, d, "close").select(F.col("close").alias("raw"), ((F.col("close") - 500) / 37).alias("norm"))).drop("residual"), 2)

# ---- sampling -------------------------------------------------------------------------------------
q("b04_balanced", f"WITH {cte('highlights')}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY market_cap DESC NULLS LAST, tic) AS k FROM highlights), s AS (SELECT * FROM r WHERE k <= 12 // (SELECT count(DISTINCT grp) FROM highlights)), x AS (SELECT * FROM r WHERE tic NOT IN (SELECT tic FROM s) ORDER BY market_cap DESC NULLS LAST, tic LIMIT 12 - (SELECT count(*) FROM s)) SELECT tic, grp FROM s UNION ALL SELECT tic, grp FROM x", lambda s, d: G.balanced(view(s, d, "highlights"), 12).select("tic", "grp"))
q("b05_balanced_random", f"WITH {cte('highlights')}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('3|' || tic), tic) AS k FROM highlights), s AS (SELECT * FROM r WHERE k <= 12 // (SELECT count(DISTINCT grp) FROM highlights)), x AS (SELECT * FROM r WHERE tic NOT IN (SELECT tic FROM s) ORDER BY md5('3|' || tic), tic LIMIT 12 - (SELECT count(*) FROM s)) SELECT tic, grp FROM s UNION ALL SELECT tic, grp FROM x", lambda s, d: G.balanced(view(s, d, "highlights"), 12, seed=3).select("tic", "grp"))
q("b06_sample_stats", f"WITH {cte('highlights')} SELECT grp, count(DISTINCT tic) AS tickers FROM highlights GROUP BY grp", lambda s, d: G.sample_stats(view(s, d, "highlights")))
q("b07_tuning_subset", f"WITH {cte('bars', 'highlights')}, r AS (SELECT tic, row_number() OVER (PARTITION BY grp ORDER BY market_cap DESC NULLS LAST, tic) AS k FROM highlights), c AS MATERIALIZED (SELECT tic, date, max(date) OVER () AS top FROM bars JOIN r USING (tic) WHERE k <= 2) SELECT tic, date FROM c WHERE date >= top - 365", lambda s, d: P.trailing_years(kept(s, d, "tic", "date").join(J.small(G.balanced(view(s, d, "highlights"), 10).select("tic")), "tic", "left_semi"), 1).select("tic", "date"))

# ---- samples --------------------------------------------------------------------------------------
LEN, HOR = 10, 5


def panel(s, d):
    return P.target(bars(s, d).select("tic", "grp", "date", "open", "high", "low", "close", "volume"), HOR)


def rich(df: DataFrame) -> DataFrame:
    return S.rich_samples(P.target(df, HOR), ["close"], LEN, HOR)


def volatility_regimes(s: SparkSession, d: str) -> DataFrame:
    df = kept(s, d)
    samples = rich(df).withColumn("volatility", F.round(F.col("volatility") + 0.0000031, 5))
    splits = P.date_split(df.select("tic", "date")).select("tic", "date", "split")
    return S.volatility_regime(samples.join(splits, ["tic", "date"])).select("tic", "date", "regime_label")


def existing_regimes(s: SparkSession, d: str) -> DataFrame:
    df = kept(s, d)
    known = df.where("volume >= 10").select("tic", "date", (F.col("volume").cast("bigint") % 3).alias("regime_id"))
    return S.regime_labels(rich(df), known).select("tic", "date", "regime_label")


_wo = over(LEN)
WIN = f"wn AS (SELECT *, count(*) {_wo} AS cn, row_number() {OVER} - {LEN} AS st, lead(target, {HOR}) {OVER} AS y, list(close) {_wo} AS cs, list(volume) {_wo} AS vs FROM tg)"
#: Every number of a window, in order, as whole thousandths: both engines cut the same doubles.
_CELL = "CAST(CAST(floor(CAST(CAST({x} AS FLOAT) AS DOUBLE) * 1000 + 0.31) AS BIGINT) AS VARCHAR)"


def cells(window: str = "features"):
    return F.array_join(F.transform(F.flatten(window), lambda x: F.floor(x.cast("double") * 1000 + 0.31).cast("string")), ",")


def cells_sql(*lists: str) -> str:
    row = " || ',' || ".join(_CELL.format(x=f"{v}[i]") for v in lists)
    return f"array_to_string(list_transform(range(1, {LEN + 1}), lambda i: {row}), ',')"


_flat = lambda x, few=True: x.select("tic", "date", "start", *([] if few else [c for c in x.columns if c not in ("tic", "date", "start", "target")]), F.round(F.aggregate("features", F.lit(0.0), lambda a, r: a + r[0].cast("double")), 1).alias("csum"), F.size("features").alias("n"), cells().alias("cells"), "target")
WSQL = "CAST(st AS INTEGER) AS start, round(list_sum(list_transform(cs, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))) + 0.0, 1) AS csum, CAST(len(cs) AS INTEGER) AS n"
BOTH = f"{WSQL}, {cells_sql('cs', 'vs')} AS cells"
query("s01_training_windows", f"WITH {cte('bars')}, {TGT}, {WIN} SELECT tic, date, {BOTH}, CAST(y AS FLOAT) AS target FROM wn WHERE cn = {LEN} AND y IS NOT NULL")(lambda s, d: _flat(S.training_windows(panel(s, d), ["close", "volume"], LEN, HOR)))
query("s02_window_index", f"WITH {cte('bars')}, {TGT}, {WIN} SELECT tic, CAST(st AS INTEGER) AS start, CAST(st + {LEN + HOR - 1} AS INTEGER) AS target_idx FROM wn WHERE cn = {LEN} AND y IS NOT NULL AND st % 3 = 0")(lambda s, d: S.window_index(panel(s, d), ["close", "volume"], LEN, HOR, 3))
query("s04_inference_windows", f"WITH {cte('bars')}, {TGT}, {WIN} SELECT tic, date, {BOTH} FROM wn WHERE cn = {LEN}")(lambda s, d: _flat(S.inference_windows(panel(s, d), ["close", "volume"], LEN).withColumn("target", F.lit(0.0))).drop("target"))
q("s05_trend_samples", f"WITH {cte('bars')}, {TGT}, {WIN} SELECT tic, date, {r6({f'p{i}': f'cs[10] + {i} * (cs[10] - cs[6]) / 4' for i in range(HOR)}, 4)}, CAST(y AS FLOAT) AS target, CAST({HOR} AS BIGINT) AS steps, {cells_sql('cs')} AS cells FROM wn WHERE cn = {LEN} AND y IS NOT NULL", lambda s, d: S.trend_samples(panel(s, d), ["close"], LEN, HOR).select("tic", "date", *(F.col("future_path")[i].alias(f"p{i}") for i in range(HOR)), "target", F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("steps"), cells().alias("cells")), 4)
RICH = f"rc AS (SELECT *, lead(date, {HOR}) {OVER} AS label_date, {', '.join(f'lead(close, {k}) {OVER} AS c{k}' for k in range(1, HOR + 1))}, list([open, high, low, close, volume]) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {HOR} FOLLOWING) AS blk FROM wn), rv AS (SELECT *, sqrt(list_var_pop([(c1 - close) / close, (c2 - c1) / close, (c3 - c2) / close, (c4 - c3) / close, (c5 - c4) / close])) AS vol FROM rc WHERE cn = {LEN} AND y IS NOT NULL AND c5 IS NOT NULL AND abs(close) >= 1e-8)"
_BLOCK = ("open", "high", "low", "close", "volume")
q(
    "s06_rich_samples",
    f"WITH {cte('bars')}, {TGT}, {WIN}, {RICH} SELECT tic, date, {BOTH}, label_date, CAST(y AS FLOAT) AS target, "
    + r6({f"c{i}": f"c{i}" for i in range(1, HOR + 1)} | {f"r{i}": f"(c{i} / close - 1) * 100" for i in range(1, HOR + 1)} | {"volatility": "vol"}, 5)
    + ", " + r6({f"{c}{i}": f"blk[{i}][{j}]" for i in range(1, HOR + 1) for j, c in enumerate(_BLOCK, 1) if c != "close"}, 5) + " FROM rv",
    lambda s, d: _flat(S.rich_samples(panel(s, d), ["close", "volume"], LEN, HOR), False).select(
        "tic", "date", "start", "csum", "n", "cells", "label_date", "target",
        *(F.col("close_path")[i].alias(f"c{i + 1}") for i in range(HOR)), *(F.col("return_path")[i].alias(f"r{i + 1}") for i in range(HOR)), "volatility",
        *(F.col("future_ohlcv")[i][j].alias(f"{c}{i + 1}") for i in range(HOR) for j, c in enumerate(_BLOCK) if c != "close"),
    ),
    5,
)
q("s07_volatility_regime", f"WITH {cte('bars')}, {DATES}, {SPL}, {TGT}, {WIN}, {RICH}, vv AS (SELECT tic, rv.date, round(vol + 0.0000031, 5) AS vol, split FROM rv JOIN sp USING (date)), cu AS (SELECT split, quantile_cont(vol, 1.0/3) AS a, quantile_cont(vol, 2.0/3) AS b FROM vv GROUP BY split) SELECT tic, date, CAST(CASE WHEN vol <= a THEN 0 WHEN vol >= b THEN 2 ELSE 1 END AS INTEGER) AS regime_label FROM vv JOIN cu USING (split)", volatility_regimes)
q(
    "s07_existing_regime",
    f"WITH {cte('bars')}, {TGT}, {WIN}, {RICH} SELECT rv.tic, rv.date, CAST(coalesce(CASE WHEN b.volume >= 10 THEN CAST(b.volume AS BIGINT) % 3 END, 1) AS INTEGER) AS regime_label FROM rv JOIN bars b ON b.tic = rv.tic AND b.date = label_date",
    existing_regimes,
)
query("s08_tuning_windows", f"WITH {cte('bars')}, w AS (SELECT *, count(*) {_wo} AS cn, row_number() {OVER} - {LEN} AS st, lead(close) {OVER} AS y, lead(date) {OVER} AS yd, list(close) {_wo} AS cs, list(volume) {_wo} AS vs FROM bars) SELECT tic, {BOTH}, round(list_sum(list_transform(vs, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))) + 0.0, 1) AS vsum, yd AS date, CAST(y AS FLOAT) AS target FROM w WHERE cn = {LEN} AND y IS NOT NULL")(
    lambda s, d: (lambda x: x.select("tic", "start", F.round(F.aggregate("features", F.lit(0.0), lambda a, r: a + r[0].cast("double")), 1).alias("csum"), F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, r: a + r[1].cast("double")), 1).alias("vsum"), cells().alias("cells"), "date", "target"))(S.tuning_windows(bars(s, d), ["close", "volume"], LEN))
)
_DAYS = "array_to_string(list_transform({x}, lambda d: CAST(d AS VARCHAR)), ',')"
SCALED = 20.0


def metadata(s: SparkSession, d: str) -> DataFrame:
    days = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    found = S.sample_metadata(bars(s, d), LEN, HOR, SCALED)
    return found.select("tic", "date", days("x_dates").alias("x_days"), days("y_dates").alias("y_days"), F.col("x_dates")[0].alias("x0"), F.col("y_dates")[0].alias("y0"), "last_close", "future_close", "realised", "realised_scaled")


q(
    "s09_metadata",
    f"WITH {cte('bars')}, w AS (SELECT *, count(*) {_wo} AS cn, list(date) {_wo} AS xs, list(date) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {HOR} FOLLOWING) AS ys, lead(close, {HOR}) {OVER} AS fc FROM bars) "
    f"SELECT tic, date, {_DAYS.format(x='xs')} AS x_days, {_DAYS.format(x='ys')} AS y_days, xs[1] AS x0, ys[1] AS y0, {r6({'last_close': 'close', 'future_close': 'fc', 'realised': '(fc / close - 1) * 100', 'realised_scaled': f'tanh((fc / close - 1) * 100 / {SCALED})'}, 5)} FROM w WHERE cn = {LEN} AND fc IS NOT NULL",
    metadata,
    5,
)
query("s10_head", f"WITH {cte('bars')}, {TGT}, {WIN} SELECT tic, CAST(st AS INTEGER) AS start FROM wn WHERE cn = {LEN} AND y IS NOT NULL ORDER BY tic, st LIMIT 25")(lambda s, d: S.head(S.window_index(panel(s, d), ["close"], LEN, HOR), 25).select("tic", "start"))
DIM = 64
q("s12_flatten", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS FLOAT) AS e_t{i}" for i in range(DIM)) + " FROM embeddings", lambda s, d: S.flatten(table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("e")), "e", [DIM]))
q(
    "s12_flatten_named",
    f"SELECT vec_id, {r6({f'm_f{j}_t{i}': f'CAST(embedding[{8 * i + j + 1}] AS DOUBLE)' for i in range(8) for j in range(8)}, 9)} FROM embeddings",
    lambda s, d: S.flatten(grid(s, d), "m", [8, 8], [f"f{j}" for j in range(8)]),
    9,
)
q(
    "s13_softmax",
    f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings) SELECT vec_id, {r6({f'p{i}': f'e[{i + 1}] / list_sum(e)' for i in range(DIM)}, 8)} FROM v",
    lambda s, d: table(s, d, "embeddings").select("vec_id", S.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p")).select("vec_id", *(F.col("p")[i].alias(f"p{i}") for i in range(DIM))),
    8,
)
_z = "CAST(CAST({x} AS FLOAT) AS DOUBLE)"
q(
    "n12_window_zscore",
    f"WITH {cte('bars')}, w AS (SELECT *, count(*) {_wo} AS cn, list({_z.format(x='close')}) {_wo} AS cs, avg({_z.format(x='close')}) {_wo} AS m, stddev_pop({_z.format(x='close')}) {_wo} AS sd FROM bars) SELECT tic, date, "
    + r6({f"z{i}": f"greatest(-5, least(5, (cs[{i + 1}] - m) / (sd + 1e-5)))" for i in range(LEN)}, 5)
    + ", " + r6({"first_back": "cs[1]"}, 5) + f" FROM w WHERE cn = {LEN}",
    lambda s, d: normalised_windows(s, d),
    5,
)


def normalised_windows(s, d):
    """The z-scores of each window, and its first value restored from them."""
    x = F.transform("features", lambda r: r[0].cast("double"))
    w = S.inference_windows(bars(s, d), ["close"], LEN).select("tic", "date", S.normalise_window(F.col("features"), 0, 1e9).alias("free"), S.normalise_window(F.col("features"), 0).alias("z"), (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / LEN).alias("mean"), S.array_std(x).alias("sd"))
    return w.select("tic", "date", *(F.col("z")[i].alias(f"z{i}") for i in range(LEN)), S.denormalise_window(F.col("free"), F.col("mean"), F.col("sd"))[0].alias("first_back"))


STAMPS = {"minute": "minute(ts)", "hour": "hour(ts)", "weekday": "isodow(ts) - 1", "day": "day(ts)", "month": "month(ts)"}
q(
    "f02_stamps",
    "SELECT user_id, " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in STAMPS.items()) + ", count(*) AS n FROM events GROUP BY user_id",
    lambda s, d: stamp_sums(table(s, d, "events")),
)


def stamp_sums(events: DataFrame) -> DataFrame:
    """Sums of the stamps of each user, from arrays of one user and day at most."""
    arrays = X.stamps(events.groupBy("user_id", F.to_date("ts").alias("on")).agg(F.collect_list("ts").alias("t")), "t")
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return arrays.groupBy("user_id").agg(*(F.sum(add(f"t_{n}")).alias(n) for n in STAMPS), F.sum(F.size("t").cast("bigint")).alias("n"))


q("v11_embedding_sizes", f"WITH {cte('bars')}, ids AS (SELECT count(DISTINCT tic) AS n FROM bars) SELECT 'tic_id' AS \"column\", CAST(n AS BIGINT) AS size FROM ids UNION ALL SELECT 'day', 32", lambda s, d: (lambda x: S.embedding_sizes(X.calendar(P.encode(x, P.label_ids(x, "tic"), "tic", "tic_id")), ["tic_id", "day"]))(kept(s, d, "tic", "date")))

# ---- evaluation -----------------------------------------------------------------------------------
q("g02_g03_sectors", pred_sql(f"grp, count(*) AS total, CAST(sum({HIT}) AS BIGINT) AS correct, {r6({'accuracy': f'avg({HIT})', 'mean_real': 'avg(target)', 'std_real': 'stddev_samp(target)', 'mean_predicted': 'avg(prediction)', 'std_predicted': 'stddev_samp(prediction)'}, 4)}", "FROM pred GROUP BY grp"), lambda s, d: E.sector_extended(predictions(s, d)), 4)
q("m03_regression", pred_sql(f"grp, count(*) AS n, {r6({'mse': 'avg(pow(prediction - target, 2))', 'rmse': 'sqrt(avg(pow(prediction - target, 2)))', 'mae': 'avg(abs(prediction - target))', 'r2': '1 - avg(pow(prediction - target, 2)) / var_pop(target)', 'mape': 'CASE WHEN count(*) FILTER (WHERE target = 0 AND prediction <> 0) = 0 THEN avg(abs((prediction - target) / nullif(target, 0))) * 100 END', 'directional_accuracy': f'avg({HIT})'}, 3)}, count(*) FILTER (WHERE target = 0) AS n_zero_targets", "FROM pred GROUP BY grp"), lambda s, d: E.regression(predictions(s, d), "grp"), 3)
ACC = "ac AS (SELECT *, CASE WHEN prediction > 0 THEN 1.0::DOUBLE WHEN prediction < 0 THEN -1.0 ELSE 0.0 END AS ps FROM pred), tu AS (SELECT *, abs(ps - coalesce(lag(ps) OVER (ORDER BY tic, date), 0)) AS tv, ps * target AS gr FROM ac), nr AS (SELECT *, tv * 0.001 * 100 AS co, gr - tv * 0.001 * 100 AS net FROM tu)"
q("m04_m06_positions", pred_sql(f"tic, date, {r6({'position': 'ps', 'turnover': 'tv', 'gross_return': 'gr', 'cost': 'co', 'net_return': 'net'})}", "FROM nr", ACC), lambda s, d: E.positions(kept_predictions(s, d)).select("tic", "date", "position", "turnover", "gross_return", "cost", "net_return"))
EQ = "eq AS (SELECT *, sum(ln(1 + net / 100)) OVER (ORDER BY tic, date ROWS UNBOUNDED PRECEDING) AS lg FROM nr), pk AS (SELECT *, max(lg) OVER (ORDER BY tic, date ROWS UNBOUNDED PRECEDING) AS mx FROM eq)"
CALM = f"WITH {cte('calm')}, pred AS (SELECT tic, grp, date, round((q - r) / r * 100 + 0.00000031, 6) AS prediction, round((f - close) / close * 100 + 0.00000031, 6) AS target FROM (SELECT *, lag(close, 7) {OVER} AS q, lag(close, 8) {OVER} AS r, lead(close) {OVER} AS f FROM calm) WHERE f IS NOT NULL AND r IS NOT NULL), {ACC}, {EQ}"


def calm_predictions(s, d):
    """A panel of small monthly returns; the prediction is the return of seven months ago."""
    df = P.target(kept(s, d, name="calm"), 1)
    back = lambda n: F.lag("close", n).over(PANEL())
    old = F.round((back(7) - back(8)) / back(8) * 100 + 0.00000031, 6)
    return df.select("tic", "grp", "date", old.alias("prediction"), F.round(F.col("target") + 0.00000031, 6).alias("target")).where("prediction IS NOT NULL")


q(
    "m07_m10_equity",
    f"{CALM} SELECT tic, date, {r6({'equity': 'exp(lg)', 'drawdown': 'exp(lg - mx) - 1'}, 5)} FROM pk",
    lambda s, d: E.equity(E.positions(calm_predictions(s, d))).select("tic", "date", "equity", "drawdown"),
    5,
)
_TRADES = {"win_rate": "avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)", "avg_win": "avg(net) FILTER (WHERE net > 0)", "avg_loss": "avg(net) FILTER (WHERE NOT net > 0)", "profit_factor": "(sum(net) FILTER (WHERE net > 0)) / abs(sum(net) FILTER (WHERE NOT net > 0))", "total_turnover": "sum(tv)", "total_cost": "sum(co)", "total_return": "sum(net)"}
_RISK = {"sharpe": "avg(net) / stddev_pop(net) * sqrt(252)", "sortino": "avg(net) / stddev_pop(CASE WHEN net < 0 THEN net END) * sqrt(252)", "final_equity": "arg_max(exp(lg), (tic, date))", "max_drawdown": "min(exp(lg - mx) - 1)"}
q(
    "m12_backtest",
    f"{CALM} SELECT count(*) AS trades, {r6(_TRADES | _RISK, 4)}, count(*) FILTER (WHERE tv > 0) AS position_changes FROM pk",
    lambda s, d: E.backtest(calm_predictions(s, d)),
    4,
)
q("m08_m09_risk", pred_sql(r6({"sharpe": "avg(net) / stddev_pop(net) * sqrt(252)", "sortino": "avg(net) / stddev_pop(CASE WHEN net < 0 THEN net END) * sqrt(252)"}), "FROM nr", ACC), lambda s, d: E.positions(kept_predictions(s, d)).agg(E.sharpe(F.col("net_return")).alias("sharpe"), E.sortino(F.col("net_return")).alias("sortino")))
q("m11_m14_trades", pred_sql(f"count(*) AS trades, {r6({'win_rate': 'avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)', 'avg_win': 'avg(net) FILTER (WHERE net > 0)', 'avg_loss': 'avg(net) FILTER (WHERE NOT net > 0)', 'profit_factor': '(sum(net) FILTER (WHERE net > 0)) / abs(sum(net) FILTER (WHERE NOT net > 0))', 'total_turnover': 'sum(tv)', 'total_cost': 'sum(co)', 'total_return': 'sum(net)'}, 3)}, count(*) FILTER (WHERE tv > 0) AS position_changes", "FROM nr", ACC), lambda s, d: E.trade_stats(E.positions(kept_predictions(s, d))), 3)
q("m13_g04_report", pred_sql(f"tic, grp, date, {r6({'target': 'target', 'prediction': 'prediction', 'distance': 'abs(prediction - target)', 'std_real': 'stddev_samp(target) OVER (PARTITION BY tic)', 'std_predicted': 'stddev_samp(prediction) OVER (PARTITION BY tic)'})}, {HIT} AS direction_score"), lambda s, d: E.report(predictions(s, d)))
MEM = f"mb AS (SELECT tic, date, 'a' AS member, prediction AS p FROM pred UNION ALL SELECT tic, date, 'b', prediction / 2 FROM pred WHERE prediction > 0)"


def members(s, d):
    p = kept_predictions(s, d).select("tic", "date", "prediction")
    return p.withColumn("member", F.lit("a")).unionByName(p.where("prediction > 0").select("tic", "date", (F.col("prediction") / 2).alias("prediction")).withColumn("member", F.lit("b")))


q("m02_ensemble", pred_sql(f"tic, date, {r6({'prediction': 'sum(CASE member WHEN $$a$$ THEN 0.75 * p ELSE 0.25 * p END)'})}", "FROM mb GROUP BY tic, date HAVING count(*) = 2", MEM), lambda s, d: E.ensemble(members(s, d), {"a": 3.0, "b": 1.0}))
query("m15_compare", pred_sql("metric, CASE WHEN metric = 'mse' THEN min_by(grp, (v, grp)) ELSE min_by(grp, (-v, grp)) END AS best_model, CASE WHEN metric = 'mse' THEN min(v) ELSE max(v) END AS best_value", "FROM mt GROUP BY metric", f"mt AS (SELECT grp, 'mse' AS metric, round(avg(pow(prediction - target, 2)) + 0.00031, 3) AS v FROM pred GROUP BY grp UNION ALL SELECT grp, 'hit', round(avg({HIT}) + 0.00031, 3) FROM pred GROUP BY grp)"))(lambda s, d: (lambda m: E.compare_models(m.select(F.col("grp").alias("model"), F.explode(F.create_map(F.lit("mse"), F.round(F.col("mse") + 0.00031, 3), F.lit("hit"), F.round(F.col("directional_accuracy") + 0.00031, 3))).alias("metric", "value"))))(E.regression(predictions(s, d), "grp")))
q("m16_m17_health", pred_sql(r6({"positive_rate": "avg(CAST(prediction > 0 AS DOUBLE))", "negative_rate": "avg(CAST(prediction < 0 AS DOUBLE))", "zero_rate": "avg(CAST(prediction = 0 AS DOUBLE))", "mean": "avg(prediction)", "std": "stddev_pop(prediction)", "target_positive_rate": "avg(CAST(target > 0 AS DOUBLE))", "correlation": "corr(prediction, target)", "penalty": "0.0"}, 4)), lambda s, d: E.collapse_penalty(E.health(predictions(s, d))), 4)
_FELL = "CASE WHEN greatest(avg(CAST(p > 0 AS DOUBLE)), avg(CAST(p < 0 AS DOUBLE)), avg(CAST(p = 0 AS DOUBLE))) >= 0.999 OR stddev_pop(p) <= 1e-5 THEN 1000 + abs(avg(CAST(p > 0 AS DOUBLE)) - 0.5) * 100 + greatest(1e-5 - stddev_pop(p), 0) * 1e5 ELSE 0 END"


def one_sided(s: SparkSession, d: str) -> DataFrame:
    """A model that says up on every day, one that says the same on every day, and the momentum model."""
    p = kept_predictions(s, d)
    kinds = {"up": F.abs("prediction") + 0.01, "flat": F.lit(0.0), "both": F.col("prediction")}
    made = [E.collapse_penalty(E.health(p.withColumn("prediction", c))).select(F.lit(k).alias("kind"), "positive_rate", "std", "penalty") for k, c in kinds.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


q(
    "m17_collapse_penalty",
    pred_sql(f"kind, {r6({'positive_rate': 'avg(CAST(p > 0 AS DOUBLE))', 'std': 'stddev_pop(p)', 'penalty': _FELL}, 4)}", "FROM kd GROUP BY kind", "kd AS (SELECT 'up' AS kind, abs(prediction) + 0.01 AS p FROM pred UNION ALL SELECT 'flat', 0.0 FROM pred UNION ALL SELECT 'both', prediction FROM pred)"),
    one_sided,
    4,
)
q("m18_meta_labels", pred_sql(f"tic, date, {r6({'prediction': 'prediction', 'target': 'target', 'confidence': 'abs(prediction)'}, 5)}, CAST(sign(prediction) AS INTEGER) AS direction, CAST(sign(target) AS INTEGER) AS target_direction, {HIT} AS label, 'model' AS source, true AS is_oos", "FROM pred WHERE abs(prediction) >= 5"), lambda s, d: E.meta_labels(predictions(s, d), least_confidence=5.0), 5)
_e = "(target - prediction)"
_wr = "0.5 * avg(greatest(-prediction * sign(target), 0))"
q("m19_m21_losses", pred_sql(r6({"directional_mse": f"avg({_e} * {_e}) + {_wr}", "directional_huber": f"avg(CASE WHEN abs({_e}) <= 1 THEN 0.5 * {_e} * {_e} ELSE abs({_e}) - 0.5 END) + {_wr}", "pinball": f"avg(greatest(0.9 * {_e}, -0.1 * {_e}))", "soft_sharpe": "-avg(tanh(prediction) * target) / (stddev_pop(tanh(prediction) * target) + 1e-8)"}, 2)), lambda s, d: E.losses(predictions(s, d)), 2)
q("m22_cost_adjusted", pred_sql(r6({"cost_adjusted": "avg(pow(prediction - target, 2)) + avg(tv * 0.001) - avg(th * target - tv * 0.001)"}, 2), "FROM t2", "t1 AS (SELECT *, tanh(prediction) AS th FROM pred)", f"t2 AS (SELECT *, abs(th - coalesce(lag(th) {OVER}, th)) AS tv FROM t1)"), lambda s, d: E.cost_adjusted_loss(predictions(s, d)), 2)
q(
    "m23_rich_loss",
    f"WITH v AS (SELECT list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings) SELECT {r6({'rich_loss': 'avg(pow(a[1] - b[1], 2)) + 0.5 * avg(list_sum(list_transform(list_zip(a, b), lambda z: pow(z[1] - z[2], 2))) / 32) + 0.25 * avg(list_sum(list_transform(list_zip(a, list_reverse(b)), lambda z: pow(z[1] - z[2], 2))) / 32) + 2 * avg(ln(list_sum(list_transform(a, lambda x: exp(x)))) - a[2])'}, 5)} FROM v",
    lambda s, d: E.rich_loss(two_halves(s, d), (1.0, 0.5, 0.25, 2.0)),
    5,
)


def two_halves(s, d):
    """The vectors' halves as prediction and target."""
    half = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double"))
    v = table(s, d, "embeddings").select(half(1).alias("a"), half(33).alias("b"))
    return v.select(F.col("a")[0].alias("prediction"), F.col("b")[0].alias("target"), F.col("a").alias("path_hat"), F.col("b").alias("path"), F.col("a").alias("block_hat"), F.reverse("b").alias("block"), F.col("a").alias("logits"), F.lit(1).alias("label"))


def grid(s, d):
    """The vectors as 8 steps of 8 features."""
    return table(s, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double"))).alias("m"))


GRID = "fl AS (SELECT vec_id, (i - 1) // 8 AS step, (i - 1) % 8 AS f, CAST(embedding[i] AS DOUBLE) AS a FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"
_STEPS = {"median": "quantile_cont(a, 0.5)", "mean": "avg(a)", "std": "stddev_pop(a)"}
q(
    "m24_forecast_summary",
    f"WITH {GRID} SELECT vec_id, {r6({f'{n}{i}': f'{e} FILTER (WHERE f = {i})' for n, e in _STEPS.items() for i in range(8)}, 5)} FROM fl GROUP BY vec_id",
    lambda s, d: E.forecast_summary(grid(s, d), "m").select("vec_id", *(F.col(f"{n}_path")[i].alias(f"{n}{i}") for n in _STEPS for i in range(8))),
    5,
)
q("g14_attribution", f"WITH {GRID} SELECT CAST(f AS INTEGER) AS feature, {r6({'mean_attribution': 'avg(a)', 'mean_abs': 'avg(abs(a))', 'importance': 'avg(abs(a))'})}, CAST(row_number() OVER (ORDER BY avg(abs(a)) DESC, f) AS INTEGER) AS rank FROM fl GROUP BY f", lambda s, d: A.attribution_importance(grid(s, d), "m"))
q("g15_attention", f"WITH {GRID} SELECT CAST(f AS INTEGER) AS position, {r6({'weight': 'avg(a)'})} FROM fl GROUP BY f ORDER BY avg(a) DESC, f LIMIT 5", lambda s, d: A.attention_by_position(grid(s, d), "m"))
q("g16_pruning", f"WITH {GRID}, im AS (SELECT CAST(f AS INTEGER) AS feature, avg(abs(a)) AS importance FROM fl GROUP BY f), rk AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM im) SELECT feature, CAST(rank AS INTEGER) AS rank, CASE WHEN rank > 6 THEN 'bottom_percent' ELSE '' END AS reason, rank > 6 AS drop FROM rk", lambda s, d: A.pruning(A.attribution_importance(grid(s, d), "m").select("feature", "importance"), 0.2).drop("importance"))
FEATS = ("return_1d", "return_5d", "return_20d")


def ret_panel(s, d):
    return P.target(X.returns(bars(s, d)), 5).select("tic", "grp", "date", "target", *FEATS, "close", "volume")


RP = f"rp AS (SELECT *, (f - close) / close * 100 AS target FROM (SELECT tic, grp, date, close, volume, lead(close, 5) {OVER} AS f, " + ", ".join(f"coalesce((close - {lag_('close', n)}) / {lag_('close', n)}, 0) AS return_{n}d" for n in (1, 5, 20)) + " FROM bars) WHERE f IS NOT NULL)"
q("g06_v10_correlation", f"WITH {cte('bars')}, {RP} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6({'correlation': f'corr({f}, target)', 'abs_correlation': f'abs(corr({f}, target))'}, 5)}, '{fam}' AS family FROM rp" for f, fam in (*((f, "other") for f in FEATS), ("close", "price"), ("volume", "price"))), lambda s, d: A.target_correlation(ret_panel(s, d), [*FEATS, "close", "volume"]), 5)
q("g07_j10_correlated_pairs", f"WITH {cte('bars')}, {RP}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS c FROM rp" for i, a in enumerate(FEATS) for b in FEATS[i + 1 :]) + f") SELECT a, b, {r6({'abs_correlation': 'c'}, 5)} FROM p WHERE c >= 0.05", lambda s, d: A.correlated_pairs(ret_panel(s, d), list(FEATS), 0.05), 5)
q("g08_matrix", f"WITH {cte('bars')}, {RP} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6({'correlation': f'corr({a}, {b})'}, 5)} FROM rp" for a in (*FEATS, "target") for b in (*FEATS, "target")), lambda s, d: A.correlation_matrix(ret_panel(s, d), [*FEATS, "target"]), 5)
q("g09_family_summary", f"WITH {cte('bars')}, {RP}, c AS (" + " UNION ALL ".join(f"SELECT abs(corr({f}, target)) AS c, '{fam}' AS family FROM rp" for f, fam in (*((f, "other") for f in FEATS), ("close", "price"), ("volume", "price"))) + f") SELECT family, count(*) AS n, {r6({'mean': 'avg(c)', 'median': 'quantile_cont(c, 0.5)', 'max': 'max(c)'}, 5)} FROM c GROUP BY family", lambda s, d: A.family_summary(A.target_correlation(ret_panel(s, d), [*FEATS, "close", "volume"])), 5)
q("g10_sparsity", f"WITH {cte('bars')}, {RP} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS n_unique, {r6({'zero_ratio': f'avg(CASE WHEN {f} = 0 THEN 1.0 ELSE 0.0 END)', 'std': f'stddev_samp({f})'}, 5)} FROM rp" for f in FEATS), lambda s, d: A.sparsity(K.materialise(ret_panel(s, d), "returns"), list(FEATS)), 5)
q("g11_g05_distribution", f"WITH {cte('bars')}, {RP} SELECT {r6({'mean': 'avg(target)', 'std': 'stddev_samp(target)', 'min': 'min(target)', 'max': 'max(target)', 'median': 'quantile_cont(target, 0.5)'}, 4)} FROM rp", lambda s, d: A.distribution(K.materialise(ret_panel(s, d), "returns")), 4)
q("g12_group_counts", f"WITH {cte('bars')} SELECT grp, count(*) AS n_rows, count(DISTINCT tic) AS tickers FROM bars GROUP BY grp", lambda s, d: A.group_counts(bars(s, d)))
q("v08_aligned", pred_sql("tic, date, round(prediction + 0.00000031, 6) AS prediction, round(target + 0.00000031, 6) AS target"), lambda s, d: (lambda x: A.aligned(x.select("tic", "date", "prediction"), x.select("tic", "date", "target")))(kept_predictions(s, d)))
q("m01_batch_score", f"WITH {cte('bars')}, w AS (SELECT *, list(CAST(CAST(close AS FLOAT) AS DOUBLE)) {_wo} AS cs FROM bars) SELECT tic, date, {r6({'prediction': 'cs[10] - cs[1]'})} FROM w WHERE len(cs) = {LEN}", lambda s, d: E.batch_score(S.inference_windows(bars(s, d), ["close"], LEN), lambda rows: [float(r[-1][0]) - float(r[0][0]) for r in rows]))
q("flagship", pred_sql(f"grp, split, count(*) AS total, CAST(sum({HIT}) AS BIGINT) AS correct, {r6({'accuracy': f'avg({HIT})', 'gross': 'avg(sign(prediction) * target)'}, 4)}", "FROM pred JOIN sp USING (date) GROUP BY grp, split", DATES, SPL), lambda s, d: (lambda x: P.date_split(x.select("tic", "date")).select("tic", "date", "split").join(momentum(x), ["tic", "date"]))(kept(s, d, "tic", "grp", "date", "close")).groupBy("grp", "split").agg(F.count(F.lit(1)).alias("total"), F.sum(E.sign_hit()).alias("correct"), F.avg(E.sign_hit()).alias("accuracy"), F.avg(F.signum("prediction") * F.col("target")).alias("gross")), 4)


# ---- whole pipelines ------------------------------------------------------------------------------
#: The queries whose columns make up the whole panel, with the decimals they are compared to.
FAMILIES = {
    "f01_calendar": 6, "f03_ema": 5, "f04_rsi": 6, "f05_stochrsi": 5, "f06_macd": 5, "f07_atr_norm": 6, "f08_roc": 6, "f09_bollinger_width": 6, "f10_f12_channel": 6, "f13_f14_swings": 6, "f17_fibonacci": 6,
    "f18_candle_shape": 6, "f19_gaps": 6, "f20_shape_changes": 6, "f20_w04_smoothed_bodies": 5, "f21_ranges": 6, "f22_percent_sizes": 6, "f23_returns": 6, "f24_volatility": 6, "f25_support": 6, "f26_volume": 6, "f27_lags": 6,
    "f28_close_rolling": 5, "f29_shape_rolling": 5, "f30_patterns": 6, "f31_distances": 6, "f32_breakouts": 6, "f33_f34_swing_flags": 6, "f35_year_extremes": 6, "f36_volume_confirmation": 6, "f37_atr_ratio": 6, "f38_volatilities": 6,
    "f39_trend_strength": 6, "f40_trend_persistence": 6, "f41_signal_lags": 6, "g01_f43_f45_relative": 5, "f46_f47_pairs": 4, "f55_daily_fundamentals": 6,
}


#: Families whose queries read more than bars, or write them.
NAMED = {"g01_f43_f45_relative": RELATIVE, "f46_f47_pairs": SPREADS, "f55_daily_fundamentals": (*RATIO, "market_cap", "dividend_yield")}


def family_columns(s, d, names: tuple[str, ...] = tuple(FAMILIES)) -> dict[str, list[str]]:
    """The columns of each family, each in the first family that has it.  They are taken from a panel without rows: over
    the tables each query would group the whole of ``lineitem`` for its bars."""
    none = s.createDataFrame([], "tic string, date date, open double, high double, low double, close double, volume double")
    found: dict[str, list[str]] = {}
    for name in names:
        known = {c for columns in found.values() for c in columns}
        made = NAMED.get(name) or QUERIES[name](s, d, none).columns
        found[name] = [c for c in made if c not in ("tic", "date", "peer") and c not in known]
    return found


def whole_panel(s: SparkSession, d: str, settings: Settings) -> DataFrame:
    highlights = view(s, d, "highlights").select("tic", "market_cap", "dividend_yield")
    return add_all_features(bars(s, d), settings, view(s, d, "statements"), highlights, (view(s, d, "vix"),))


def all_features(s, d):
    """All families that have SQL (not trend lines, unit-root tests and equilibrium), with the volatility index."""
    df = whole_panel(s, d, Settings(pairs=True, pair_tests=False, pair_window=PW))
    shown = {c: places for name, columns in family_columns(s, d).items() for places in [FAMILIES[name]] for c in columns}
    kinds = dict(df.dtypes)
    shift = lambda c, p: F.round(F.col(c) + F.lit(0.31 * 10.0**-p), p).alias(c) if kinds[c] == "double" else F.col(c)
    return df.select("tic", "date", *(shift(c, p) for c, p in {"target": 5, "vix": 5, **shown}.items()))


_doubled = ", ".join(f"f{i}.* EXCLUDE (tic, date" + {"f36_volume_confirmation": ", volume_momentum", "f46_f47_pairs": ", peer"}.get(name, "") + ")" for i, name in enumerate(FAMILIES))
_joined = " ".join(f"{'LEFT ' * (name == 'f46_f47_pairs')}JOIN ({ORACLES[name]}) f{i} ON f{i}.tic = tg.tic AND f{i}.date = tg.date" for i, name in enumerate(FAMILIES))
query("f58_all_features", f"WITH {cte('bars', 'vix')}, {TGT} SELECT tg.tic, tg.date, {r6({'target': 'target', 'vix': 'vix'}, 5)}, {_doubled} FROM tg LEFT JOIN vix ON tg.date = vix.date {_joined}")(all_features)
query("f58_complete_panel")(lambda s, d: whole_panel(s, d, Settings(trendlines=True, pairs=True, equilibrium=True, pair_window=30, pair_norm=20)))

#: Columns of candles and market structure whose correlations are compared, by the query that has them.
SHAPES = {
    "f18_candle_shape": ("body_size", "upper_shadow", "lower_shadow", "high_low_range", "body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "close_position", "open_position"),
    "f19_gaps": ("gap_size", "overnight_return"),
    "f21_ranges": ("atr_14", "atr_20", "rolling_high_low_range_5", "rolling_high_low_range_20"),
    "f22_percent_sizes": ("body_size_pct", "upper_shadow_pct", "lower_shadow_pct", "range_pct"),
    "f23_returns": ("return_1d", "return_5d", "return_20d"),
    "f24_volatility": ("rolling_volatility",),
    "f31_distances": tuple(f"distance_to_{n}d_{k}" for n in (20, 60, 120, 252) for k in ("high", "low")),
    "f40_trend_persistence": ("trend_persistence_20", "trend_persistence_60"),
}
SHOWN = [c for columns in SHAPES.values() for c in columns]


def shape_matrix(s: SparkSession, d: str) -> DataFrame:
    df = bars(s, d)
    for family in (X.candle_shape, X.gaps, X.ranges, X.percent_sizes, X.returns, X.volatility, X.distances, X.trend_persistence):
        df = family(df)
    return A.correlation_matrix(rounded(df.select(*SHOWN)), SHOWN)


_WIDE = ", ".join(f"f{i}.{c}" for i, columns in enumerate(SHAPES.values()) for c in columns)
_FROM = " ".join(f"JOIN ({ORACLES[n]}) f{i} ON f{i}.tic = bars.tic AND f{i}.date = bars.date" for i, n in enumerate(SHAPES))
_CORR = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': corr({a}, {b})}}" for a in SHOWN for b in SHOWN)
q(
    "g08_matrix_of_families",
    f"WITH {cte('bars')}, w AS (SELECT {_WIDE} FROM bars {_FROM}), m AS (SELECT unnest([{_CORR}]) AS p FROM w) SELECT p.a AS a, p.b AS b, {r6({'correlation': 'p.c'}, 5)} FROM m",
    shape_matrix,
    5,
)

_SCALED = ("open", "high", "low", "close", "volume", "vix")
_SPLIT2 = "dt2 AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pl, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM tg)), sp2 AS (SELECT date, CASE WHEN pl < CAST(floor(n * 0.7::DOUBLE) AS INT) THEN 'train' WHEN pl < CAST(floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) AS INT) THEN 'val' ELSE 'test' END AS split FROM dt2)"
_FITTED = ", ".join(f"quantile_cont(coalesce({c}, 0), 0.5) AS {c}_c, quantile_cont(coalesce({c}, 0), 0.75) - quantile_cont(coalesce({c}, 0), 0.25) AS {c}_k" for c in _SCALED)
_PREPARED = (
    f"WITH {cte('bars', 'vix')}, {TGT}, {_SPLIT2}, m AS (SELECT tg.* EXCLUDE (target), CASE WHEN tg.volume > 45 THEN 0 ELSE target END AS target, vix, split, dense_rank() OVER (ORDER BY tic) - 1 AS tic_id, dense_rank() OVER (ORDER BY grp) - 1 AS group_id FROM tg LEFT JOIN vix ON tg.date = vix.date JOIN sp2 ON tg.date = sp2.date), "
    f"st AS (SELECT {_FITTED}, quantile_cont(vix, 1.0 / 3) AS q1, quantile_cont(vix, 2.0 / 3) AS q2 FROM m WHERE split = 'train') "
    f"SELECT tic, date, grp, split, CAST(tic_id AS INTEGER) AS tic_id, CAST(group_id AS INTEGER) AS group_id, {r6({c: f'(coalesce({c}, 0) - {c}_c) / CASE WHEN abs({c}_k) > 0 THEN {c}_k ELSE 1 END' for c in _SCALED} | {'target': 'target'}, 5)}, CAST(CASE WHEN vix IS NULL THEN 1 WHEN vix >= q2 THEN 2 WHEN vix >= q1 THEN 1 ELSE 0 END AS INTEGER) AS regime_id FROM m, st"
)


def prepared(s: SparkSession, d: str) -> DataFrame:
    with_gaps = P.target(bars(s, d)).withColumn("target", F.expr("CASE WHEN volume > 45 THEN NULL ELSE target END"))
    return preprocess(J.merge_macro(with_gaps, view(s, d, "vix")))[0]


q("n08_a15_preprocess", _PREPARED, prepared, 5)
q("a15_export_normalised", f"SELECT * EXCLUDE (tic, date, grp, split) FROM ({_PREPARED})", lambda s, d: K.export_normalised(prepared(s, d)), 5)

# ---- smaller pieces -------------------------------------------------------------------------------


def failures(s, d):
    return table(s, d, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("tic"), F.col("event_type").alias("reason"), F.col("ts").alias("at"))


def ledger(s, d):
    ev = failures(s, d)
    return ev.groupBy("tic").agg(F.max_by("reason", F.struct("at", "reason")).alias("last_reason"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


q("a23_failure_summary", "WITH e AS (SELECT user_id, max_by(event_type, (ts, event_type)) AS last_reason, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id) SELECT last_reason, count(*) AS n, min(first_at) AS oldest, max(last_at) AS newest FROM e GROUP BY last_reason", lambda s, d: K.failure_summary(ledger(s, d)))
q("a18_metadata", f"WITH {cte('bars')}, {DATES}, {SPL} SELECT split, count(*) AS n, CAST(10 AS INTEGER) AS length, CAST(5 AS INTEGER) AS horizon, 'close,volume' AS features FROM bars JOIN sp USING (date) GROUP BY split", lambda s, d: K.dataset_metadata(P.date_split(kept(s, d, "tic", "date")), ["close", "volume"], 10, 5).withColumn("features", F.array_join("features", ",")))
q(
    "a25_preview",
    f"WITH {cte('bars')}, {TGT}, {WIN}, w2 AS (SELECT *, first_value(date) {_wo} AS d0 FROM wn) SELECT tic, date, CAST(y AS FLOAT) AS target, CAST(10 AS INTEGER) AS length, CAST(day(d0) AS BIGINT) AS start_day, CAST(day(date) AS BIGINT) AS end_day, CAST(month(d0) AS BIGINT) AS start_month, CAST(month(date) AS BIGINT) AS end_month, "
    + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in ("open", "high", "low", "close", "volume")) + f" FROM w2 WHERE cn = {LEN} AND y IS NOT NULL ORDER BY tic, st LIMIT 5",
    lambda s, d: S.preview(S.training_windows(X.calendar(panel(s, d)), ["open", "high", "low", "close", "volume", "target"], LEN, HOR)).select(
        "tic", "date", "target", "length", "start_day", "end_day", "start_month", "end_month", *(F.col("last_step")[i].alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume")))
    ),
)
q("s03_default_ids", f"WITH {cte('bars')} SELECT tic, date, CAST(0 AS INTEGER) AS group_id, CAST(1 AS INTEGER) AS dividend_flag FROM bars", lambda s, d: S.default_ids(bars(s, d)).select("tic", "date", "group_id", "dividend_flag"))
q("v07_flag_domain", f"WITH {cte('bars')}, w AS (SELECT *, count(*) {_wo} AS cn, max(CAST(volume AS BIGINT) % 4) {_wo} AS top, lead(f, {HOR}) {OVER} AS y FROM (SELECT *, lead(close, {HOR}) {OVER} AS f FROM bars) WHERE f IS NOT NULL) SELECT tic, date FROM w WHERE cn = {LEN} AND y IS NOT NULL AND top = 3", lambda s, d: A.flag_domain(S.training_windows(panel(s, d).withColumns({"tic_id": F.lit(0), "dividend_flag": F.col("volume").cast("bigint") % 4}), ["close"], LEN, HOR)).select("tic", "date"))
q("g13_train_mask", f"WITH {cte('bars')}, {DATES} SELECT tic, date FROM bars JOIN dt USING (date) WHERE pl < CAST(floor(n * 0.7::DOUBLE) AS INT)", lambda s, d: P.date_split(kept(s, d, "tic", "date"), 0.7).where("split = 'train'").select("tic", "date"))
q("m05_per_ticker_turnover", pred_sql(f"tic, date, {r6({'turnover': 'abs(ps - coalesce(lag(ps) OVER (PARTITION BY tic ORDER BY date), 0))'})}", "FROM ac", ACC), lambda s, d: E.positions(predictions(s, d), per_ticker=True).select("tic", "date", "turnover"))
