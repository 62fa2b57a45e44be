"""Hand-computed values, edge cases and the no-look-ahead rule."""

import datetime as dt
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loompanel.functions.econometrics import adf, johansen_vector
from loompanel.operators import analyse as A
from loompanel.operators import evaluate as E
from loompanel.operators import features as X
from loompanel.operators import joins as J
from loompanel.operators import prepare as P
from loompanel.operators import recurrences as R
from loompanel.operators import samples as S
from loompanel.operators import sampling as G
from loompanel.operators import sector as C
from loompanel.operators import trendlines as L
from loompanel.sources import ingest as I
from loompanel.sources import sinks as K

DAY = dt.date(2024, 1, 1)


def panel(spark, tickers=("A", "B"), days=60, seed=1, late=0.0):
    r = random.Random(seed)
    rows = []
    for t in tickers:
        p = 100.0
        for i in range(days):
            p *= 1 + r.uniform(-0.03, 0.03)
            o = p * (1 + r.uniform(-0.01, 0.01))
            bump = late if i >= days - 5 else 0.0
            rows.append((t, "G" if t < "C" else "H", DAY + dt.timedelta(i), o, max(o, p) * 1.01 + bump, min(o, p) * 0.99 - bump, p + bump, float(r.randint(1, 99))))
    return spark.createDataFrame(rows, "tic string, grp string, date date, open double, high double, low double, close double, volume double")


def test_ema_first_equals_pandas(spark):
    df = panel(spark, days=300)
    got = R.ema_first(df, "e", "close", 5).orderBy("tic", "date").toPandas()
    want = got.groupby("tic")["close"].transform(lambda s: s.ewm(span=5, adjust=False).mean())
    assert (got["e"] - want).abs().max() < 1e-9


def test_wilder_seed(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(i), c) for i, c in enumerate([1.0, 2.0, 3.0, 2.0, 4.0])], "tic string, date date, close double")
    got = [r.rsi_2 for r in R.rsi(df, 2).orderBy("date").collect()]
    assert got[:2] == [None, None] and got[2] == 1.0
    # gains 1, 1, 0, 2 and losses 0, 0, 1, 0
    assert got[3] == pytest.approx(0.5 / 1.0) and got[4] == pytest.approx(1.25 / 1.5)


@pytest.mark.parametrize("family", [X.market_structure, X.candlesticks, X.fibonacci, X.channel, X.swings, R.technical, X.roc, X.bollinger_width])
def test_no_look_ahead(spark, family):
    def early(late):
        out = family(panel(spark, ("A",), 90, late=late))
        drop = [c for c in out.columns if c.startswith("slope_")]  # leading gaps of these are filled backwards by definition
        return out.where(F.col("date") < DAY + dt.timedelta(85)).drop(*drop).orderBy("date").collect()

    assert early(0.0) == early(50.0)


def test_existing_columns_win_and_flat_bars(spark):
    flat = spark.createDataFrame([("A", DAY, 1.0, 1.0, 1.0, 1.0, 0.0)], "tic string, date date, open double, high double, low double, close double, volume double").withColumn("doji", F.lit(7))
    r = X.candlesticks(flat).first()
    assert r.doji == 7 and r.body_ratio == 0.0 and r.return_1d == 0.0 and r.hammer == 0
    assert X.market_structure(flat).first().atr_ratio == 0.0


def test_as_of_drops_early_quarters_and_keeps_known_values(spark):
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(i)) for i in (10, 20, 30)], "tic string, date date")
    q = spark.createDataFrame([("A", DAY, 1.0, 1.0), ("A", DAY + dt.timedelta(15), 2.0, 5.0), ("A", DAY + dt.timedelta(25), None, 6.0)], "tic string, date date, x double, y double")
    assert [(r.x, r.y) for r in J.as_of(bars, q, ["x", "y"]).orderBy("date").collect()] == [(None, None), (2.0, 5.0), (2.0, 6.0)]
    assert [r.y for r in J.interpolate(bars, q, ["y"]).orderBy("date").collect()] == [None, 5.5, 6.0]


def test_highlights_and_market_cap(spark):
    docs = spark.createDataFrame([("A", '{"Highlights": {"PERatio": "12.5", "DividendYield": "0", "DividendShare": "2", "MarketCapitalization": "0", "MarketCap": "7"}}'), ("B", '{"Highlights": {"PERatio": "x"}, "General": {"MarketCap": "3"}}'), ("C", None)], "tic string, v string").select("tic", F.from_json("v", I.FUNDAMENTALS).alias("doc"))
    h = {r.tic: r for r in I.highlights(docs).collect()}
    assert (h["A"].pe_ratio, h["A"].dividend_flag, h["B"].pe_ratio, h["B"].dividend_flag, h["C"].dividend_flag) == (12.5, 1, None, 2, 2)
    assert {r.tic: r.market_cap for r in I.market_caps(docs).collect()} == {"A": 7.0, "B": 3.0, "C": None}


def test_split_bounds_in_floating_point(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(i)) for i in range(10)], "tic string, date date")
    counts = {r.split: r["count"] for r in P.date_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 7, "test": 3}


def test_regime_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 20.0, 30.0, 40.0, 50.0, None)], "vix double").withColumn("split", F.lit("train"))
    cuts = P.fit_regime(df, "vix", (0.5, 0.75))
    assert cuts == [30.0, 40.0] and [r.regime_id for r in P.regime(df, "vix", cuts).collect()] == [0, 0, 1, 2, 2, 1]
    assert P.restore_regime(P.regime_params(spark, "vix", cuts)) == (cuts, 1)


def test_folds_keep_their_gap(spark):
    df = panel(spark, ("A",), 20).select("tic", "date")
    b = {(r.fold, r.role): (r["first"], r["last"]) for r in P.fold_bounds(P.walk_forward(df, 6, 2, 3, 4)).collect()}
    assert (b[0, "val"][0] - b[0, "train"][1]).days == 3 and len(b) == 6
    e = {(r.fold, r.role): (r["first"], r["last"]) for r in P.fold_bounds(P.purged_folds(df, 3, 1, 8)).collect()}
    assert e[2, "val"][1] == DAY + dt.timedelta(19) and e[2, "train"][0] == DAY


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(1.0, "train"), (1.0, "train"), (3.0, "test")], "x double, split string")
    for m in ("robust", "standard", "minmax"):
        assert [r.x for r in P.scale(df, P.fit_scaler(df, ["x"], m), m).collect()] == [0.0, 0.0, 2.0]


def test_trend_path_and_labels(spark):
    df = spark.createDataFrame([([3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0],)], "v array<double>")
    assert df.select(S.trend_path(F.col("v"), 4, 5).alias("p")).first().p == [9.0, 10.0, 11.0, 12.0]


def test_window_label_looks_ahead_twice(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(i), float(i), float(100 + i)) for i in range(9)], "tic string, date date, x double, target double")
    rows = S.training_windows(df, ["x"], 3, 2).orderBy("start").collect()
    assert [r.target for r in rows] == [104.0, 105.0, 106.0, 107.0, 108.0] and rows[0].features == [[0.0], [1.0], [2.0]]
    assert S.training_windows(df.limit(2), ["x"], 3, 2).count() == 0
    hole = df.withColumn("x", F.when(F.col("x") != 4, F.col("x")))
    assert [r.start for r in S.window_index(hole, ["x"], 3, 2).orderBy("start").collect()] == [0, 1]


def test_backtest_account_runs_across_tickers(spark):
    df = spark.createDataFrame([("A", "G", DAY, 1.0, 10.0), ("A", "G", DAY + dt.timedelta(1), -1.0, 10.0), ("B", "G", DAY, -1.0, -20.0)], "tic string, grp string, date date, prediction double, target double")
    rows = E.equity(E.positions(df, commission=0.0)).orderBy("tic", "date").collect()
    assert [r.turnover for r in rows] == [1.0, 2.0, 0.0]
    assert [round(r.equity, 6) for r in rows] == [1.1, 0.99, 1.188] and round(rows[1].drawdown, 6) == -0.1
    assert [r.turnover for r in E.positions(df, per_ticker=True).orderBy("tic", "date").collect()] == [1.0, 2.0, 1.0]
    s = E.trade_stats(E.positions(df, commission=0.0)).first()
    assert s.profit_factor == 3.0 and s.win_rate == pytest.approx(2 / 3)


def test_ensemble_needs_every_member_and_pruning_refuses_the_test_split(spark):
    m = spark.createDataFrame([("A", DAY, "x", 1.0), ("A", DAY, "y", 3.0), ("B", DAY, "x", 1.0)], "tic string, date date, member string, prediction double")
    assert [(r.tic, r.prediction) for r in E.ensemble(m).collect()] == [("A", 2.0)]
    with pytest.raises(ValueError):
        A.pruning(spark.createDataFrame([(0, 1.0)], "feature int, importance double"), split="test")
    with pytest.raises(ValueError):
        A.column_contract(["a"], {"x": ["b"]})


def test_balanced_sampling_covers_groups(spark):
    t = spark.createDataFrame([(f"T{i}", f"G{i % 3}", float(i) if i % 4 else None) for i in range(12)], "tic string, grp string, market_cap double")
    assert G.balanced(t, 7).groupBy("grp").count().count() == 3 and G.balanced(t, 7).count() == 7
    assert sorted(r.tic for r in G.balanced(t, 2).collect()) == ["T10", "T11"]
    assert G.balanced(t, 5, seed=1).collect() == G.balanced(t, 5, seed=1).collect() and G.balanced(t.limit(0), 3).count() == 0


def test_pairs_equal_direct_computation(spark):
    df = panel(spark, ("A", "B", "BB"), 30)
    got = {(r.tic, r.date): r for r in C.spreads(df, 12, 5).collect()}
    wide = df.toPandas().pivot(index="date", columns="tic", values="close")
    ret = wide.pct_change(fill_method=None)
    end = wide.index[20]
    w, rr = wide.iloc[9:21], ret.iloc[9:21]
    peer = max(("B", "BB"), key=lambda c: abs(rr["A"].corr(rr[c])))
    beta = w["A"].cov(w[peer]) / w[peer].var()
    spread = w["A"] - beta * w[peer]
    r = got["A", end]
    assert r.peer == peer and r.pair_beta == pytest.approx(beta) and r.spread_zscore == pytest.approx((spread.iloc[-1] - spread.mean()) / spread.std(ddof=0))
    tested = {(r.tic, r.date): r for r in C.spread_adf(df, C.spreads(df, 12, 5), 12).collect()}
    assert set(tested) == set(got)
    stat, p = adf(spread.to_numpy())
    assert tested["A", end].spread_adf_stat == pytest.approx(stat) and tested["A", end].spread_adf_pvalue == pytest.approx(p)


def test_spread_tests_of_a_table_read_twice(spark, tmp_path):
    """The panel and the panel that its spreads come from are two readings of one table, joined and grouped as a query's are."""
    panel(spark, ("A", "B", "C", "D"), 40).write.parquet(str(tmp_path / "bars"))

    def bars():
        return spark.read.parquet(str(tmp_path / "bars")).groupBy("tic", "grp", "date").agg(F.max("close").alias("close"))

    keys, once = ["tic", "date"], bars()
    want = C.spread_adf(once, C.spreads(once, 12, 5), 12).orderBy(*keys).collect()
    got = C.spread_adf(bars(), C.spreads(bars(), 12, 5), 12).orderBy(*keys).collect()
    assert got == want and len(got) > 50 and any(r.spread_adf_stat is not None for r in got)


def test_spread_tests_of_the_whole_panel_equal_direct_computation(spark):
    """f48_f49: the z-score of the spread and its unit-root test, row by row in pandas."""
    df = panel(spark, ("A", "B", "BB", "C", "D"), 40, seed=3)
    got = {(r.tic, r.date): r for r in C.spread_adf(df, C.spreads(df, 12, 6), 12).collect()}
    rows = {(r.tic, r.date): r for r in df.collect()}
    groups = {}
    for t, d in rows:
        groups.setdefault(rows[t, d].grp, {}).setdefault(t, {})[d] = rows[t, d].close
    seen = 0
    for members in groups.values():
        wide = pd.DataFrame(members).sort_index()
        ret = wide.pct_change(fill_method=None)
        spreads = {}
        for i in range(11, len(wide)):
            w, rr = wide.iloc[i - 11 : i + 1], ret.iloc[i - 11 : i + 1]
            for t in wide:
                c = {o: abs(rr[t].corr(rr[o])) for o in wide if o != t}
                if not c:
                    continue
                peer = min(c, key=lambda o: (-round(c[o], 12), o))
                s = w[t] - w[t].cov(w[peer]) / w[peer].var() * w[peer]
                spreads.setdefault(t, {})[wide.index[i]] = s.iloc[-1]
                r = got[t, wide.index[i]]
                stat, p = adf(s.to_numpy())
                assert r.peer == peer and (r.spread_adf_stat, r.spread_adf_pvalue) == (pytest.approx(stat, abs=1e-6), pytest.approx(p, abs=1e-6))
                last = pd.Series(spreads[t]).iloc[-6:]
                want = (last.iloc[-1] - last.mean()) / last.std(ddof=0) if len(last) == 6 else None
                assert r.spread_norm == (pytest.approx(want, abs=1e-6) if want is not None else None)
                seen += 1
    assert seen == len(got) > 100


def test_equilibrium_of_the_whole_panel_equals_direct_computation(spark):
    """f50_f52, window by window in numpy."""
    import numpy as np

    df = panel(spark, ("A", "B", "BB", "C", "D"), 45, seed=5)
    got = {(r.grp, r.date): r for r in C.equilibrium(df, 30, 10).collect()}
    members = {}
    for r in df.collect():
        members.setdefault(r.grp, {}).setdefault(r.tic, {})[r.date] = r.close
    for grp, closes in members.items():
        wide = np.log(pd.DataFrame(closes).sort_index())
        gaps = {}
        for i in range(29, len(wide)):
            w = wide.iloc[i - 29 : i + 1]
            s = w.to_numpy() @ johansen_vector(w.to_numpy())
            r = got.pop((grp, wide.index[i]))
            gaps[wide.index[i]] = s[-1]
            stat, p = adf(s)
            assert r.equilibrium_gap == pytest.approx(s[-1]) and r.equilibrium_zscore == pytest.approx((s[-1] - s[-10:].mean()) / s[-10:].std())
            assert r.equilibrium_adf_stat == pytest.approx(stat) and r.equilibrium_adf_pvalue == pytest.approx(p)
            last = pd.Series(gaps).iloc[-10:]
            assert r.equilibrium_gap_norm == (pytest.approx((last.iloc[-1] - last.mean()) / last.std(ddof=0)) if len(last) == 10 else None)
    assert not got


@pytest.fixture
def plain_corr(spark):
    """Without the error that ``corr`` is where a column has no variance."""
    spark.conf.set("spark.sql.ansi.enabled", "false")
    yield
    spark.conf.unset("spark.sql.ansi.enabled")


def holed(spark, tickers, days, seed):
    """A panel with gaps, a flat ticker and a close of 0."""
    r = random.Random(seed)
    flat = F.when(F.col("tic") == tickers[-1], 50.0).otherwise(F.col("close"))
    df = panel(spark, tickers, days, seed).withColumn("close", F.when((F.col("tic") == tickers[0]) & (F.dayofyear("date") == 20), 0.0).otherwise(flat))
    gone = spark.createDataFrame([(t, DAY + dt.timedelta(r.randrange(days))) for t in tickers for _ in range(2)], "tic string, date date")
    return df.join(gone, ["tic", "date"], "left_anti")


def test_pairs_over_blocks_and_chunks(spark, monkeypatch, plain_corr):
    """Blocks of two tickers and chunks of nine dates give what one block and chunk give, and what windows over all
    pairs give."""
    from pyspark.sql import Window as W

    df = holed(spark, ("A", "AA", "AB", "B", "BB", "BC", "BD", "C", "D"), 70, 4).persist()
    keys = ("tic", "date", "peer")
    whole = C.spread_adf(df, C.spreads(df, 12, 5), 12).orderBy(*keys).collect()
    monkeypatch.setattr(C, "BLOCK", 2)
    monkeypatch.setattr(C, "CHUNK", 9)
    parts = C.spread_adf(df, C.spreads(df, 12, 5), 12).orderBy(*keys).collect()
    assert len(whole) == len(parts) > 100
    for x, y in zip(whole, parts):
        assert [x[k] for k in keys] == [y[k] for k in keys] and [v for v in x[3:]] == pytest.approx([v for v in y[3:]], nan_ok=True)
    grid = df.select("grp", "date").distinct().join(df.select("grp", "tic").distinct(), "grp").join(df.select("grp", "tic", "date", "close"), ["grp", "tic", "date"], "left")
    before = F.lag("close").over(W.partitionBy("tic").orderBy("date"))
    grid = grid.withColumn("r", F.try_divide(F.col("close") - before, F.nullif(before, F.lit(0.0))))
    other = grid.select("grp", "date", F.col("tic").alias("peer"), F.col("close").alias("x"), F.col("r").alias("rx"))
    w = W.partitionBy("tic", "peer").orderBy("date").rowsBetween(-11, 0)
    joint = F.col("r").isNotNull() & F.col("rx").isNotNull()
    pairs = grid.join(other, ["grp", "date"]).where("tic <> peer").select("tic", "peer", "date", F.count("close").over(w).alias("ny"), F.count("x").over(w).alias("nx"), F.count(F.when(joint, 1)).over(w).alias("n"), F.abs(F.corr(F.when(joint, F.col("r")), F.when(joint, F.col("rx"))).over(w)).alias("c"))
    pairs = pairs.where("ny = 12 AND nx = 12 AND n >= 10 AND c IS NOT NULL AND NOT isnan(c)")
    first = F.row_number().over(W.partitionBy("tic", "date").orderBy(F.desc("c"), "peer"))
    assert [(r.tic, r.date, r.peer) for r in pairs.withColumn("k", first).where("k = 1").orderBy("tic", "date").collect()] == [(r.tic, r.date, r.peer) for r in whole]
    assert "D" not in {r.peer for r in whole}  # a flat close has no correlation
    plan = C.chosen_peers(df, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "peer" not in plan.split("FlatMapGroupsInPandas")[1].split("\n", 1)[1]  # no pair is joined


def test_equilibrium_over_chunks(spark, monkeypatch):
    df = holed(spark, ("A", "AA", "B", "C", "D"), 70, 6)
    whole = C.equilibrium(df, 30, 10).orderBy("grp", "date").collect()
    monkeypatch.setattr(C, "CHUNK", 7)
    parts = C.equilibrium(df, 30, 10).orderBy("grp", "date").collect()
    assert len(whole) == len(parts) > 60 and sum(r.equilibrium_gap is not None for r in whole) > 10
    for x, y in zip(whole, parts):
        assert x[:2] == y[:2] and [v for v in x[2:]] == pytest.approx([v for v in y[2:]], abs=1e-6)


def test_correlations_equal_corr(spark, plain_corr):
    """One pass over all pairs, with unknown values, large means, constant columns and constant overlaps."""
    r = random.Random(8)
    some = lambda v, p: v if r.random() < p else None
    rows = []
    for i in range(3000):
        x = r.gauss(0, 1)
        rows.append((x, some(x + r.gauss(0, 0.3), 0.7), some(1e9 + x, 0.9), 0.1, some(5.5, 0.5), None, some(r.choice([0, 1]), 0.4), float("nan") if i % 50 == 0 else x * 1e-9, 7.0 if i < 2999 else 8.0, some(1.5, 0.001)))
    names = list("abcdefghkl")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" if c != "g" else "g int" for c in names)).repartition(7)
    got = {(x.a, x.b): x.correlation for x in A.correlation_matrix(df, names).collect()}
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in names))
    want = clean.agg(*(F.corr(a, b).alias(f"{a}{b}") for a in names for b in names)).first()
    assert len(got) == 100
    for a in names:
        for b in names:
            w = want[f"{a}{b}"]
            w = None if w is None or math.isnan(w) else w
            # about a mean of 1e9 the two-pass sum itself is good to some 1e-8
            assert got[a, b] == (w if w is None else pytest.approx(w, abs=1e-7 if "c" in (a, b) else 1e-9)), (a, b)
    pairs = {(x.a, x.b): x.abs_correlation for x in A.correlated_pairs(df, names, 0.5).collect()}
    assert set(pairs) == {k for k, v in got.items() if k[0] < k[1] and v is not None and abs(v) >= 0.5} and ("a", "b") in pairs
    assert A.correlated_pairs(df, names, None, signed=True).count() == 45 and A.correlation_matrix(df.limit(0), names).count() == 0


def test_wide_correlations_take_one_scan(spark):
    names = [f"x{i}" for i in range(300)]
    df = spark.range(2000).select(*(F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)))
    found = A.correlation_matrix(df, names)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    sample = {(r.a, r.b): r.correlation for r in found.where("a = 'x7' AND b IN ('x0', 'x299', 'x7')").collect()}
    want = df.agg(*(F.corr("x7", b).alias(b) for b in ("x0", "x299", "x7"))).first()
    assert all(sample["x7", b] == pytest.approx(want[b], abs=1e-9) for b in ("x0", "x299", "x7")) and found.count() == 90_000


def test_unit_root_and_cointegration():
    import numpy as np

    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=300), rng.normal(size=300).cumsum()
    assert adf(noise)[1] < 0.01 < 0.1 < adf(walk)[1] and adf(np.ones(50)) == (None, None)
    v = johansen_vector(np.column_stack([walk, 2 * walk + rng.normal(size=300) * 0.1]))
    assert v[0] / v[1] == pytest.approx(-2, abs=0.05)


def test_no_window_is_shuffled_or_sorted(spark):
    """Windows of samples and trend lines are made after the one shuffle and sort by ticker: what these move are the
    panel's own columns."""
    import re

    df = P.target(panel(spark, ("A", "B"), 40))
    made = {
        "s01": S.training_windows(df, ["close", "volume"], 10, 5), "s04": S.inference_windows(df, ["close", "volume"], 10), "s05": S.trend_samples(df, ["close"], 10, 5),
        "s06": S.rich_samples(df, ["close", "volume"], 10, 5), "s08": S.tuning_windows(df, ["close", "volume"], 10), "s09": S.sample_metadata(df, 10, 5), "f15": L.trendlines(df, 20),
    }
    for name, out in made.items():
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\(\d+\) (?:Exchange|Sort)\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
        columns = {c.split("#")[0] for m in moved for c in m.split(", ")}
        assert moved and columns <= {*df.columns, "f", "_w0", "_we0"} | {c for c in columns if c.startswith("_w")}, (name, columns)
        assert plan.count(") Exchange") <= 2, name


def test_trendlines_do_not_cross(spark):
    df = panel(spark, ("A",), 50)
    rows = L.trendlines(df, 30).where("opt_slope_sup_30 IS NOT NULL").collect()
    assert len(rows) == 21 and all(r.opt_channel_width_30 > 0 for r in rows)


def test_trendlines_equal_a_row_by_row_search(spark):
    """f15_f16: least squares line, then steps of halving length from the touched bar, in plain Python."""
    import numpy as np

    def search(y, pivot, slope, above, tolerance=1e-4):
        def error(s):
            gaps = [s * (i - pivot) + y[pivot] - v for i, v in enumerate(y)]
            crossed = min(gaps) < -tolerance if above else max(gaps) > tolerance
            return float("inf") if crossed else sum(g * g for g in gaps)

        best = error(slope)
        if best == float("inf"):
            slope, best = 0.0, error(0.0)
        step = max(max(max(y) - min(y), tolerance) / (len(y) - 1), tolerance)
        for _ in range(40):
            if step <= tolerance:
                break
            down, up = error(slope - step), error(slope + step)
            if min(down, up) < float("inf") and min(down, up) <= best:
                slope, best = (slope - step, down) if down <= up else (slope + step, up)
            else:
                step /= 2
        return slope

    df = panel(spark, ("A", "B"), 45, seed=9)
    got = {(r.tic, r.date): r for r in L.trendlines(df, 20).collect()}
    for t in ("A", "B"):
        rows = df.where(F.col("tic") == t).orderBy("date").collect()
        for i, r in enumerate(rows):
            g = got[t, r.date]
            if i < 19:
                assert g.opt_slope_sup_20 is None and g.opt_slope_res_20 is None
                continue
            w = rows[i - 19 : i + 1]
            close, low, high = ([x[c] for x in w] for c in ("close", "low", "high"))
            slope, base = np.polyfit(range(20), close, 1)
            line = [base + slope * k for k in range(20)]
            lo = min(range(20), key=lambda k: low[k] - line[k])
            hi = max(range(20), key=lambda k: high[k] - line[k])
            sup, res = search(low, lo, slope, False), search(high, hi, slope, True)
            assert (g.opt_slope_sup_20, g.opt_slope_res_20) == (pytest.approx(sup, abs=1e-6), pytest.approx(res, abs=1e-6))
            assert g.opt_channel_width_20 == pytest.approx(res * (19 - hi) + high[hi] - sup * (19 - lo) - low[lo], abs=1e-4)


def test_readers(spark, tmp_path):
    df = panel(spark, ("A",), 3)
    df.write.parquet(str(tmp_path / "saved/stocks.parquet"))
    df.select("date").write.parquet(str(tmp_path / "saved/vix.parquet"))
    assert set(I.load_saved(spark, str(tmp_path / "saved"))) == {"stocks", "vix"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.load_saved(spark, str(tmp_path / "none"))
    df.write.option("header", True).csv(str(tmp_path / "bars.csv"))
    assert I.read_scoring(spark, str(tmp_path / "bars.csv")).count() == I.read_scoring(spark, str(tmp_path / "saved/stocks.parquet")).count() == 3
    df.drop("volume").write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="volume"):
        I.read_scoring(spark, str(tmp_path / "short"))
    quarter = '{"quarterly": {"2024-03-31": {"totalAssets": "10", "netIncome": "x"}, "bad": {"totalAssets": "1"}}}'
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "AB.json").write_text('{"Financials": {"Balance_Sheet": %s, "Income_Statement": {"quarterly": {"2024-06-30": {"netIncome": "3"}}}}}' % quarter)
    rows = {(r.tic, str(r.date)): (r.totalAssets, r.netIncome) for r in I.statements(I.read_fundamentals(spark, str(tmp_path / "f"))).collect()}
    assert rows["AB", "2024-03-31"] == (10.0, None) and rows["AB", "2024-06-30"] == (None, 3.0)  # either side alone


def test_contracts_and_inventories(spark):
    assert A.column_contract(["tic", "vix"], {"key": ["tic"]}, {"macro": ["vix", "bondyield"]}) == {"macro": {"present": ["vix"], "missing": ["bondyield"]}}
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1,)], "x int")
    A.same_columns({"train": a, "val": a}, ["x"])
    for splits, wanted in (({"train": a, "val": b}, None), ({"train": a}, ["z"])):
        with pytest.raises(ValueError):
            A.same_columns(splits, wanted)
    found = {r.family: r.n for r in A.feature_inventory(spark, ["tic", "date", "target", "rsi_7", "ema_50", "ema_200", "vix", "odd"]).collect()}
    assert found == {"rsi": 1, "ema": 2, "macro": 1, "other": 1}
    assert X.structure_metadata(["close", "doji"], ["close", "doji", "higher_high"]) == {"generated": ["higher_high"], "preserved": ["close", "doji"], "windows": [20, 60, 120, 252]}
    v = spark.createDataFrame([(0.5,)], "x double").select(P.apply_inverse(F.col("x"), "affine", 2.0, 1.0).alias("a"), P.apply_inverse(F.col("x"), "log", 1.0, 3.0).alias("l")).first()
    assert v.a == 2.0 and v.l == pytest.approx(3.6487212707)
    logs = spark.createDataFrame([(float(i), math.log1p(i + 4.0)) for i in range(1, 9)], "raw double, norm double")
    f = P.fit_inverse(logs).first()
    assert f.kind == "log" and f.b == pytest.approx(-4.0) and f.residual < 1e-9
    s = spark.createDataFrame([([3],), ([4, 3],)], "stock_id array<int>")
    assert P.samples_by_ids(s, [3]).count() == 1


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_exact_quantiles_equal_percentile(spark, accuracy):
    from loompanel.functions.quantiles import exact_quantiles

    r = random.Random(2)
    rows = [(r.gauss(0, 1), float(r.choice([0, 0, 0, 0, 1, 2])), r.randint(-5, 5) if r.random() < 0.5 else None, None, float(i % 7 == 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "x double, ties double, holes int, none double, rare double").repartition(5)
    shares = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0)
    got = exact_quantiles(df, df.columns, shares, accuracy)
    want = df.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in df.columns)).first()
    for c in df.columns:
        assert got[c] == (pytest.approx(want[c]) if want[c] is not None else [None] * len(shares))
    one = exact_quantiles(spark.createDataFrame([(2.0,)], "x double"), ["x"], (0.5,))
    assert one == {"x": [2.0]} and exact_quantiles(df.limit(0), ["x"], (0.5,)) == {"x": [None]}


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_no_more_than_the_bound_is_gathered(spark, monkeypatch, accuracy):
    """Brackets are narrowed until 50 values at most lie inside; by group, as percentile does."""
    from loompanel.functions import quantiles as Q

    r = random.Random(6)
    rows = [(r.choice("aab") if i else None, r.lognormvariate(0, 4), float(r.choice([0, 0, 0, 0, 0, 1, 2])), r.uniform(-1, 1) ** 9 if r.random() < 0.3 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, x double, ties double, tight double").repartition(5)
    sizes, passes = [], []
    gathered, narrow = Q._gathered, Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    monkeypatch.setattr(Q, "_gathered", lambda rows, brackets, most: sizes.extend((b, g, i) for (g, i, j), b in brackets.items()) or gathered(rows, brackets, most))
    shares = (0.0, 0.25, 0.5, 2 / 3, 1.0)
    got = Q.grouped_quantiles(df, "g", ["x", "ties", "tight"], shares, accuracy, most=50)
    want = df.groupBy("g").agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in ("x", "ties", "tight"))).collect()
    assert len(got) == len(want) == 3 and passes
    for w in want:
        for c in ("x", "ties", "tight"):
            assert got[w.g][c] == (pytest.approx(w[c], rel=1e-12) if w[c] is not None else [None] * 5)
    names = ["x", "ties", "tight"]
    for b, g, i in sizes:  # what lies strictly inside the last bracket is what is gathered
        assert sum(row[0] == g and row[1 + i] is not None and b.low < row[1 + i] < b.high for row in rows) <= 50, names[i]
    assert Q.exact_quantiles(df, ["x"], (0.5,), accuracy, most=50)["x"][0] == pytest.approx(df.agg(F.percentile("x", F.lit(0.5))).first()[0])


def test_regime_labels(spark):
    df = panel(spark, ("A",), 20).withColumn("target", F.lit(1.0))
    samples = S.rich_samples(df, ["close"], 4, 2).withColumn("split", F.lit("train"))
    known = df.where(F.col("date") < DAY + dt.timedelta(10)).select("tic", "date", F.lit(2).alias("regime_id"))
    got = {r.label_date: r.regime_label for r in S.regime_labels(samples, known).collect()}
    assert all(v == (2 if k < DAY + dt.timedelta(10) else 1) for k, v in got.items()) and len(got) == samples.count()
    assert {r.regime_label for r in S.regime_labels(samples).collect()} == {0, 1, 2}
    assert {r.regime_label for r in S.regime_labels(samples, included=False).collect()} == {0}


def test_preprocess_exports_before_the_fill(spark, tmp_path):
    from loompanel.plans.pipelines import preprocess

    df = panel(spark, ("A", "B"), 20).withColumn("vix", F.when(F.dayofmonth("date") % 2 == 0, F.lit(20.0))).withColumn("target", F.lit(1.0))
    out, params = preprocess(df, export=str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert raw.where("vix IS NULL").count() > 0 == out.where("vix IS NULL").count() and "tic_id" in raw.columns and raw.count() == out.count() == 40
    back = J.realign(out.select("tic", "date", "close"), raw, ("tic", "date"))
    assert back.where("raw_close < 50").count() == 0
    K.export_normalised(out, str(tmp_path / "ready"))
    assert not {"tic", "date", "grp", "split"} & set(spark.read.parquet(str(tmp_path / "ready")).columns)
    with pytest.raises(ValueError, match="target"):
        preprocess(df.drop("target"))


def test_splits_arrays_metadata_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("A", 0, "train", [1.0, 2.0], [1]), ("A", 1, "val", [3.0], [2])], "tic string, start int, split string, features array<double>, day_seq array<int>")
    K.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=val")).first().features == [3.0]
    K.write_arrays(df, str(tmp_path / "a"), ["features", "day_seq"])
    parts = [spark.read.parquet(str(tmp_path / "a" / k)) for k in ("features", "day_seq")]
    assert parts[0].join(parts[1], ["split", "tic", "start"]).select(df.columns).orderBy("start").collect() == df.orderBy("start").collect()
    K.write_metadata(spark, str(tmp_path / "m"), ["x", "y"], 10, 5, P.regime_params(spark, "vix", [1.0, 2.0]), num_stocks=3)
    info = json.loads(spark.read.text(str(tmp_path / "m/info")).first().value)
    assert info["regime_params"] == {"vix": {"cut_0": 1.0, "cut_1": 2.0, "default": 1.0}} and info["num_stocks"] == 3 and info["feature_cols"] == ["x", "y"]
    assert [r.value for r in spark.read.text(str(tmp_path / "m/features")).collect()] == ["x", "y"]
    K.report_sinks({"trades": df}, str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r/trades")).columns == ["split", "start", "tic"]
    K.report_sinks({"trades": df}, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c/trades")).count() == 2
    shown = S.preview(df.withColumn("date", F.lit(DAY)).withColumn("target", F.lit(1.0)).withColumn("features", F.array("features"))).first()
    assert (shown.start_day, shown.end_day, shown.start_month, shown.last_step) == (1, 1, -1, [1.0, 2.0])


def test_failure_ledger(spark):
    at = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([("A", "x", at), ("A", "y", at + dt.timedelta(1)), ("B", "z", at)], "tic string, reason string, at timestamp")
    empty = spark.createDataFrame([], "tic string, first_reason string, last_reason string, first_at timestamp, last_at timestamp, attempts bigint")
    ledger = K.failure_upsert(K.failure_upsert(empty, new), new.where("tic = 'B'"))
    rows = {r.tic: (r.first_reason, r.last_reason, r.attempts) for r in ledger.collect()}
    assert rows == {"A": ("x", "y", 2), "B": ("z", "z", 2)}
    assert [r.tic for r in K.failure_removed(ledger, "A").collect()] == ["B"] and K.failure_removed(ledger).count() == 0
    names = spark.createDataFrame([("A",), ("C",)], "tic string")
    assert [r.tic for r in K.without_failed(names, ledger).collect()] == ["C"] and K.without_failed(names, ledger, enabled=False).count() == 2
    assert {r.last_reason: r.n for r in K.failure_summary(ledger).collect()} == {"y": 1, "z": 1}


def test_places_over_parts(spark, monkeypatch):
    """Ranks, carries and running products by parts are those of one window, and no exchange goes to one task."""
    from loompanel.functions import ranks as N

    r = random.Random(4)
    rows = [(f"T{r.randrange(10**6):06d}é"[: r.randrange(3, 8)], DAY + dt.timedelta(r.randrange(30)), r.uniform(0.9, 1.1)) for _ in range(900)]
    df = spark.createDataFrame(rows, "tic string, date date, g double").dropDuplicates(["tic"]).persist()
    df.count()
    one = N.with_earlier(N.with_earlier(N.with_place(df, ["date", "tic"]), ["tic"], F.col("g"), "p"), ["tic"], F.col("p") * F.col("g"), "m", "max").orderBy("tic").collect()
    monkeypatch.setattr(N, "ROWS", 50)
    made = N.with_earlier(N.with_earlier(N.with_place(df, ["date", "tic"]), ["tic"], F.col("g"), "p"), ["tic"], F.col("p") * F.col("g"), "m", "max")
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    for x, y in zip(one, made.orderBy("tic").collect(), strict=True):
        assert (x.tic, x.place, x.p, x.m) == (y.tic, y.place, pytest.approx(y.p), y.m if y.m is None else pytest.approx(y.m))
    assert sorted(x.place for x in one) == list(range(len(one))) and one[0].m is None and one[0].p == 1.0
    ids = P.label_ids(df, "tic")
    assert [x.tic for x in ids.orderBy("id").collect()] == [x.tic for x in one] and "SinglePartition" not in ids._jdf.queryExecution().executedPlan().toString()
    more = P.extend_ids(ids.where("id < 100"), df, "tic")
    assert sorted(x.id for x in more.collect()) == list(range(len(one)))
    small = spark.createDataFrame([(f"T{i:03d}", "G", DAY + dt.timedelta(k), r.choice([-1.0, 1.0]), r.uniform(-3, 3)) for i in range(120) for k in range(3)], "tic string, grp string, date date, prediction double, target double")
    parted = E.equity(E.positions(small)).orderBy("tic", "date").collect()
    monkeypatch.setattr(N, "ROWS", 10**6)
    for x, y in zip(E.equity(E.positions(small)).orderBy("tic", "date").collect(), parted, strict=True):
        assert (x.turnover, x.equity, x.drawdown) == (y.turnover, pytest.approx(y.equity), pytest.approx(y.drawdown))


def test_sparsity_equals_distinct_counts(spark):
    r = random.Random(9)
    rows = [(float(r.randrange(40)), r.randrange(2) if r.random() < 0.9 else None, 2**60 + r.randrange(30), r.choice(["a", "b", None]), r.choice([0.0, -0.0, float("nan"), 1.0]), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x double, flag int, wide bigint, name string, odd double, none double").repartition(6)
    got = {q.feature: q.n_unique for q in A.distinct_counts(df, df.columns).collect()}
    assert got == {"x": 40, "flag": 2, "wide": 30, "name": 2, "odd": 3}
    found = A.sparsity(df, ["x", "flag", "none"])
    assert {q.feature: q.n_unique for q in found.collect()} == {"x": 40, "flag": 2, "none": 0}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_bars_are_checked(spark):
    df = panel(spark, ("A",), 30)
    for f in (X.market_structure, A.ohlcv_contract):
        with pytest.raises(ValueError, match="volume"):
            f(df.drop("volume"))
    holes = df.withColumn("open", F.when(F.dayofmonth("date") > 3, F.col("open")))
    assert {r.feature: (r.nulls, r.rows) for r in A.null_counts(holes).collect()}["open"] == (3, 30)
    assert X.market_structure(df, X.Structure(enabled=False)).columns == df.columns
    own = X.market_structure(df, X.Structure(windows=(5,), breakouts=(7,), count=4, trends=(6,), lags=(2,)))
    assert {"distance_to_5d_high", "breakout_7d", "higher_high_count_4", "trend_persistence_6", "higher_high_lag_2"} <= set(own.columns)
    assert not {"distance_to_20d_high", "breakout_20d", "higher_high_lag_1", "breakout_20d_lag_2"} & set(own.columns)
    upside_down = spark.createDataFrame([("A", DAY, 2.0, 1.0, 3.0, 2.5, 1.0)], "tic string, date date, open double, high double, low double, close double, volume double")
    r = X.candle_shape(upside_down).first()
    assert (r.high_low_range, r.body_ratio, r.close_position, r.open_position) == (0.0, 0.0, 0.0, 0.0)


def test_a_half_written_stage_is_made_again(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2.0).repartition(4)
    folder, made = str(tmp_path), []

    def make():
        made.append(1)
        return df

    path = f"{folder}/s/fingerprint={K.fingerprint({'a': 1})}"

    class Killed(Exception):
        pass

    def dies():
        df.where("id < 50").write.parquet(f"{path}/run=dead")  # whole files, but the run never ends
        raise Killed

    with pytest.raises(Killed):
        K.stage(spark, folder, "s", {"a": 1}, dies)
    assert K.published(spark, path, K.fingerprint({"a": 1})) is None
    assert K.stage(spark, folder, "s", {"a": 1}, make).count() == 100 and len(made) == 1
    assert K.stage(spark, folder, "s", {"a": 1}, make).count() == 100 and len(made) == 1  # taken from before
    marks = spark.read.schema(K.MARK).json(f"{path}/published").collect()
    assert len(marks) == 1 and marks[0].rows == 100
    part = next((tmp_path / "s").glob(f"*/run={marks[0].run}/part-*.parquet"))
    part.unlink()  # a lost file: the number of rows tells
    assert K.stage(spark, folder, "s", {"a": 1}, make).count() == 100 and len(made) == 2
    for p in (tmp_path / "s").glob("*/run=*/*"):
        p.unlink()
    assert K.stage(spark, folder, "s", {"a": 1}, make).count() == 100 and len(made) == 3
    stray = f"{folder}/t/fingerprint={K.fingerprint({})}"
    df.write.parquet(f"{stray}/run=x")
    spark.createDataFrame([("x", "other", json.dumps(df.dtypes), 100)], K.MARK).write.json(f"{stray}/published")
    assert K.published(spark, stray, K.fingerprint({})) is None  # of another fingerprint


def test_the_complete_panel_has_every_family(spark):
    """With all switches on, the columns of pairs, unit-root tests, equilibrium, trend lines and statements are those
    of the operators by themselves."""
    from loompanel.plans.pipelines import Settings, add_all_features

    df = holed(spark, ("A", "AA", "B", "C"), 90, 12).persist()
    quarters = spark.createDataFrame([("A", DAY + dt.timedelta(9), 10.0, 4.0, 6.0, 5.0, 2.0, 1.0), ("A", DAY + dt.timedelta(40), 20.0, 4.0, 6.0, 5.0, 2.0, 1.0)], "tic string, date date, totalAssets double, totalLiab double, totalStockholderEquity double, totalCurrentAssets double, totalCurrentLiabilities double, netIncome double")
    s = Settings(technical=False, geometric=False, trendlines=True, structure=False, fibonacci=False, candles=False, pairs=True, equilibrium=True, pair_window=20, norm_window=15, pair_norm=10)
    got = {(r.tic, r.date): r.asDict() for r in add_all_features(df, s, statements=quarters).collect()}
    assert set(got) == {(r.tic, r.date) for r in P.target(df).collect()}
    same = lambda a, b: a == b or (a is not None and b is not None and a == pytest.approx(b, abs=1e-9, nan_ok=True))
    pairs = {(r.tic, r.date): r.asDict() for r in C.spread_adf(df, C.spreads(df, 20, 10), 20).collect()}
    sectors = {(r.grp, r.date): r.asDict() for r in C.equilibrium(df, 20, 10).collect()}
    lines = {(r.tic, r.date): r.asDict() for r in L.trendlines(df).collect()}
    known = {(r.tic, r.date): r.asDict() for r in J.as_of(df, J.ratios(quarters), ["roe", "roi", "debt_to_equity", "debt_to_asset", "current_ratio"]).collect()}
    gap = {(r.tic, r.date): r.relative_price_vs_sector_norm for r in C.relative(df, 15).collect()}
    assert sum(k in pairs for k in got) > 30 and sum(v["equilibrium_gap"] is not None for v in got.values()) > 20 and sum(v["roe"] is not None for v in got.values()) > 20
    for k, row in got.items():
        for source, key in ((pairs, k), (sectors, (row["grp"], row["date"])), (lines, k), (known, k)):
            want = source.get(key)
            for c in next(iter(source.values())):
                if c not in ("tic", "date", "grp", "peer", *df.columns):
                    assert same(row[c], want and want[c]), (k, c)
        assert same(row["relative_price_vs_sector_norm"], gap[k])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", DAY, 1.0)], "tic string, date date, x double")
    made = []
    for _ in range(2):
        K.stage(spark, str(tmp_path), "s", {"a": 1}, lambda: made.append(1) or df).collect()
    assert len(made) == 1
    K.stage(spark, str(tmp_path), "s", {"a": 1}, lambda: made.append(1) or df, (X.calendar,)).collect()  # other code
    K.stage(spark, str(tmp_path), "s", {"a": 2}, lambda: made.append(1) or df).collect()  # other settings
    assert len(made) == 3 and K.fingerprint({}, (X.calendar,)) != K.fingerprint({}, (X.roc,))
    with pytest.raises(ValueError):
        K.export_normalised(df.withColumn("name", F.lit("x")))
    K.append_run(spark, str(tmp_path / "runs"), {"run": "a", "metrics": {"mse": 1}})
    K.append_run(spark, str(tmp_path / "runs"), {"run": "b", "metrics": {"mse": 2}})
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    K.write_predictions(df, str(tmp_path / "p"))
    assert pd.concat(pd.read_csv(f) for f in (tmp_path / "p").glob("*.csv"))["x"].tolist() == [1.0]
