"""Features of a ticker against its sector (column ``grp``): relative prices, pair spreads, equilibrium."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.functions.columns import nn, pct, td, zscore
from loompanel.functions.econometrics import adf, johansen_from_moments, johansen_rows

MICRO = 1_000_000
#: Tickers of a block and dates of a chunk; numbers held at a time where windows are cut out; steps of sliding sums.
BLOCK, CHUNK, CELLS, REFRESH = 64, 1024, 1 << 22, 128


def leave_one_out(c: str) -> Column:
    """Mean of the sector's other known values of a day.  Sums are exact integers of millionths, so they
    do not depend on the order of rows."""
    exact = F.round(F.col(c) * MICRO).cast("bigint")
    others = F.count(exact).over(W.partitionBy("grp", "date")) - 1
    return F.when(others >= 1, (F.sum(exact).over(W.partitionBy("grp", "date")) - exact) / MICRO / others)


def relative(df: DataFrame, norm: int = 60) -> DataFrame:
    """Return, price and return against the sector's other tickers, and the z-score of the price gap."""
    out = df.withColumn("stock_return_1d", pct("close"))
    out = out.withColumns({"__pc": leave_one_out("close"), "__pr": leave_one_out("stock_return_1d")})
    out = out.withColumns({"relative_price_vs_sector": td(F.col("close") - F.col("__pc"), F.nullif(F.abs("__pc"), F.lit(0.0))), "relative_return_vs_sector": F.col("stock_return_1d") - F.col("__pr")})
    return out.withColumn("relative_price_vs_sector_norm", zscore("relative_price_vs_sector", norm)).drop("__pc", "__pr")


def _in_chunks(rows: DataFrame, halo: int) -> DataFrame:
    """Rows with a place, once for each date chunk that needs them (their own, and those that they are at most
    ``halo`` rows before), with its number and the place that its halo starts at (``base``)."""
    place = F.col("place")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(place / CHUNK), F.floor((place + halo) / CHUNK))))
    return rows.withColumn("base", F.col("chunk") * CHUNK - halo)


def _numbered(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, tic, block, blocks) and (grp, date, place): tickers of a sector in blocks by name, its dates by number.
    Both are small: distinct tickers and distinct dates of a sector."""
    names = panel.select("grp", "tic").distinct().withColumn("block", F.floor((F.row_number().over(W.partitionBy("grp").orderBy("tic")) - 1) / BLOCK))
    days = panel.select("grp", "date").distinct().withColumn("place", F.row_number().over(W.partitionBy("grp").orderBy("date")) - 1)
    return names.withColumn("blocks", F.max("block").over(W.partitionBy("grp")) + 1), days


def _units(panel: DataFrame, window: int) -> DataFrame:
    """(grp, a, b, chunk, base, tic, block, place, date, close): the rows of each two blocks of a sector (a <= b) and date
    chunk, with the ``window`` rows before the chunk.  A row is copied once for each block of its sector, and
    once more where it is before a chunk."""
    names, days = _numbered(panel)
    rows = panel.select("grp", "tic", "date", "close").join(names, ["grp", "tic"]).join(days, ["grp", "date"])
    rows = _in_chunks(rows, window).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return rows.select("grp", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "chunk", "base", "tic", "block", "place", "date", "close")


def _dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Closes of a unit by place and ticker (sorted; NaN where there is none), its tickers and dates by number, and
    the place of the first row."""
    base = int(rows["base"].iloc[0])
    tics, column = np.unique(rows["tic"].to_numpy().astype(str), return_inverse=True)
    line = rows["place"].to_numpy() - base
    closes = np.full((int(line.max()) + 1, len(tics)), np.nan)
    closes[line, column] = rows["close"].to_numpy(dtype=np.float64, na_value=np.nan)
    dates = np.empty(len(closes), dtype=object)
    dates[line] = rows["date"].to_numpy()
    return closes, tics, dates, base


def _complete(values: np.ndarray, window: int) -> np.ndarray:
    """For each row from number window - 1 on which columns are known in all of its last ``window`` rows."""
    known = np.vstack([np.zeros((1, values.shape[1]), dtype=np.int64), np.cumsum(np.isfinite(values), axis=0)])
    return known[window:] - known[:-window] == window


def _correlation(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Absolute correlations (day, i, j) of windows x (day, i, row) and y (day, j, row) over the rows where both are
    known; -1 under ``least`` rows or without variance."""

    def centred(v):
        known = np.isfinite(v)
        n = np.maximum(known.sum(axis=2, keepdims=True), 1)
        own = np.where(known, v, 0.0)
        return np.where(known, v - own.sum(axis=2, keepdims=True) / n, 0.0), known.astype(np.float64), (own * own).sum(axis=2)

    (x, kx, size_x), (y, ky, size_y) = centred(x), centred(y)
    turn = lambda v: v.transpose(0, 2, 1)
    n = kx @ turn(ky)
    share = 1 / np.maximum(n, 1)
    sx, sy = x @ turn(ky), kx @ turn(y)
    qx, qy = (x * x) @ turn(ky) - sx * sx * share, kx @ turn(y * y) - sy * sy * share
    good = (n >= least) & (qx > 1e-20 * size_x[:, :, None]) & (qy > 1e-20 * size_y[:, None, :])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(good, np.abs(x @ turn(y) - sx * sy * share) / np.sqrt(qx * qy), -1.0)


PEER = ("c", "y", "x", "my", "mx", "vy", "vx", "cxy", "pair_beta")


def _best_peers(rows: pd.DataFrame, window: int, least: int) -> pd.DataFrame:
    """For each ticker and day of a unit its best peer among the tickers of the other block."""
    grp, a, b = rows["grp"].iloc[0], rows["a"].iloc[0], rows["b"].iloc[0]
    closes, tics, dates, _ = _dense(rows)
    of = dict(zip(rows["tic"], rows["block"]))
    block = np.array([of[t] for t in tics])
    own, other = np.flatnonzero(block == a), np.flatnonzero(block == b)
    out = []
    if len(closes) > window and len(tics) > 1:
        before = np.where(closes[:-1] == 0, np.nan, closes[:-1])
        returns = np.vstack([np.full((1, len(tics)), np.nan), (closes[1:] - before) / before])
        whole = _complete(closes, window)
        sliding = lambda v: np.lib.stride_tricks.sliding_window_view(v, window, axis=0)
        moves, levels = sliding(returns), sliding(closes)
        for at in range(1, len(moves), max(1, CELLS // (window * len(tics)))):  # the window of row 0 ends before the chunk
            to = min(len(moves), at + max(1, CELLS // (window * len(tics))))
            c = _correlation(moves[at:to, own], moves[at:to, other], least)
            c[~(whole[at:to, own, None] & whole[at:to, None, other])] = -1
            if a == b:
                c[:, np.arange(len(own)), np.arange(len(own))] = -1
            for mine, theirs, table in ((own, other, c), *(() if a == b else ((other, own, c.transpose(0, 2, 1)),))):
                if not table.shape[2]:
                    continue
                peer = table.argmax(axis=2)  # the first by name of equals
                best = np.take_along_axis(table, peer[:, :, None], axis=2)[:, :, 0]
                day, i = np.nonzero(best >= 0)
                j = theirs[peer[day, i]]
                y, x = levels[at + day, mine[i]], levels[at + day, j]
                my, mx = y.mean(axis=1), x.mean(axis=1)
                y0, x0 = y - my[:, None], x - mx[:, None]
                vy, vx, cxy = (y0 * y0).mean(axis=1), (x0 * x0).mean(axis=1), (y0 * x0).mean(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    values = (best[day, i], y[:, -1], x[:, -1], my, mx, vy, vx, cxy, np.where(vx > 0, cxy / vx, np.nan))
                out.append(pd.DataFrame({"grp": grp, "tic": tics[mine[i]], "date": dates[at + day + window - 1], "peer": tics[j], **dict(zip(PEER, values))}))
    return pd.concat(out) if out else pd.DataFrame(columns=["grp", "tic", "date", "peer", *PEER])


def chosen_peers(panel: DataFrame, window: int = 252, least: int = 10) -> DataFrame:
    """For each ticker and day with complete windows, the peer of largest absolute return correlation (the
    first by name of equals), with the regression of closes on the peer's.

    Tickers of a sector are dealt in blocks and its dates in chunks: a task has two blocks over one chunk and
    the ``window`` rows before it, takes all their correlations by products of matrices, and gives one row for
    each ticker and day.  No row is made for a pair; of the blocks' best peers the best is kept.
    """
    kinds = dict(panel.dtypes)
    kind = f"grp {kinds['grp']}, tic {kinds['tic']}, date {kinds['date']}, peer {kinds['tic']}, " + ", ".join(f"{c} double" for c in PEER)

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        return _best_peers(rows, window, least)

    found = _units(panel, window).groupBy("grp", "a", "b", "chunk").applyInPandas(best, kind)
    first = F.min_by(F.struct("peer", *PEER), F.struct(-F.col("c"), "peer"))
    return found.groupBy("grp", "tic", "date").agg(first.alias("p")).select("grp", "tic", "date", "p.*").where("vx > 0")


def spreads(panel: DataFrame, window: int = 252, norm: int = 60) -> DataFrame:
    """tic, date, peer, pair_beta, spread and its statistics under the current beta, for rows with a peer,
    and the spread's z-score over the ticker's sector calendar."""
    p = chosen_peers(panel, window)
    beta = F.col("pair_beta")
    p = p.withColumns({"spread": F.col("y") - beta * F.col("x"), "rolling_mean_spread": F.col("my") - beta * F.col("mx")})
    spread = F.sqrt(F.greatest(F.col("vy") - beta * F.col("cxy") * 2 + beta * beta * F.col("vx"), F.lit(0.0)))
    p = p.withColumn("rolling_std_spread", F.nullif(spread, F.lit(0.0)))
    p = p.withColumn("spread_zscore", td(F.col("spread") - F.col("rolling_mean_spread"), F.col("rolling_std_spread")))
    keep = ["grp", "tic", "date", "peer", "pair_beta", "spread", "rolling_mean_spread", "rolling_std_spread", "spread_zscore"]
    calendar = panel.select("grp", "date").distinct().join(panel.select("grp", "tic").distinct(), "grp")
    out = calendar.join(p.select(*keep), ["grp", "tic", "date"], "left")
    return out.withColumn("spread_norm", zscore("spread", norm)).where("peer IS NOT NULL").drop("grp")


def spread_adf(panel: DataFrame, chosen: DataFrame, window: int = 252) -> DataFrame:
    """``chosen`` (of ``spreads``) with the unit-root statistic and p-value of each window's spread under its beta.

    A chosen row meets the closes of its two blocks and date chunk; windows are cut out inside the task."""
    names, days = _numbered(panel)
    peers = names.select("grp", F.col("tic").alias("peer"), F.col("block").alias("peer_block"))
    wanted = chosen.join(names, "tic").join(peers, ["grp", "peer"]).join(days, ["grp", "date"])
    # Both sides of the cogroup are made of the panel: every column of this one is given a name of its own.
    asked_columns = {"k_grp": F.col("grp"), "k_a": F.least("block", "peer_block"), "k_b": F.greatest("block", "peer_block"), "k_chunk": F.floor(F.col("place") / CHUNK), "k_place": F.col("place")}
    wanted = wanted.select(*(e.alias(n) for n, e in asked_columns.items()), *(F.col(c).alias(f"x_{c}") for c in chosen.columns))

    def solve(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        closes, tics, _, base = _dense(rows)
        at = {t: i for i, t in enumerate(tics)}
        out = []
        for tic, place, peer, beta in zip(asked["x_tic"], asked["k_place"], asked["x_peer"], asked["x_pair_beta"]):
            span = slice(place - base - window + 1, place - base + 1)
            out.append(adf(closes[span, at[tic]] - beta * closes[span, at[peer]]))
        tested = pd.DataFrame(out, columns=["stat", "p"], dtype="float64")
        return pd.concat([asked[[f"x_{c}" for c in chosen_columns]].reset_index(drop=True), tested], axis=1)

    keys, chosen_columns = ["grp", "a", "b", "chunk"], chosen.columns
    kind = ", ".join(f"x_{c} {t}" for c, t in chosen.dtypes) + ", stat double, p double"
    tested = _units(panel, window).groupBy(*keys).cogroup(wanted.groupBy(*(f"k_{k}" for k in keys))).applyInPandas(solve, kind)
    return tested.select(*(F.col(f"x_{c}").alias(c) for c in chosen.columns), nn("stat").alias("spread_adf_stat"), nn("p").alias("spread_adf_pvalue"))


def _solved(rows: pd.DataFrame, window: int, norm: int, lags: int) -> pd.DataFrame:
    """One row for each day of a sector's date chunk, from moment matrices that slide: the new day's products are
    added and the oldest one's taken off; every REFRESH days they are summed anew."""
    logs, _, dates, base = _dense(rows)
    out = []
    if len(logs) >= window:
        m = logs.shape[1]
        whole = _complete(logs, window)
        known = np.isfinite(logs)
        centre = np.where(known, logs, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        z = johansen_rows(logs - centre, lags)
        n = window - lags - 1
        moments = np.zeros((z.shape[1], z.shape[1]))
        for end in range(window - 1, len(logs)):
            new = end - lags - 1  # the row of z that belongs to the day
            if (end - window + 1) % REFRESH == 0:
                moments = z[new - n + 1 : new + 1].T @ z[new - n + 1 : new + 1]
            else:
                moments += np.outer(z[new], z[new]) - np.outer(z[new - n], z[new - n])
            if base + end < window - 1:  # the sector's calendar has no full window yet
                continue
            held = np.flatnonzero(whole[end - window + 1])
            pick = np.concatenate([held + k * m for k in range(lags + 2)] + [[(lags + 2) * m]])
            v = johansen_from_moments(moments[np.ix_(pick, pick)], n, len(held), lags) if len(held) >= 2 else None
            if v is None:
                out.append((dates[end], None, None, None, None))
                continue
            s = logs[end - window + 1 : end + 1, held] @ v
            last = s[-min(len(s), norm) :]
            sd = last.std()
            out.append((dates[end], float(s[-1]), float((s[-1] - last.mean()) / sd) if sd else None, *adf(s)))
    found = pd.DataFrame(out, columns=["date", "gap", "z", "stat", "p"]).astype({c: "float64" for c in ("gap", "z", "stat", "p")})
    found.insert(0, "grp", rows["grp"].iloc[0])
    return found


def equilibrium(panel: DataFrame, window: int = 252, norm: int = 60, lags: int = 1) -> DataFrame:
    """grp, date, the last value of the sector's first cointegrating combination, its z-score over the last
    ``norm`` points and the unit-root test, from the tickers that are complete in the window.

    A task has a sector's closes of one date chunk and the window before it, however many days there are."""
    known = panel.where("close > 0").select("grp", "date", "tic", F.ln("close").alias("close"))
    rows = _in_chunks(known.join(_numbered(known)[1], ["grp", "date"]), window - 1)
    kinds = dict(panel.dtypes)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        return _solved(part, window, norm, lags)

    solved = rows.groupBy("grp", "chunk").applyInPandas(solve, f"grp {kinds['grp']}, date {kinds['date']}, gap double, z double, stat double, p double")
    solved = solved.select("grp", "date", nn("gap").alias("equilibrium_gap"), nn("z").alias("equilibrium_zscore"), nn("stat").alias("equilibrium_adf_stat"), nn("p").alias("equilibrium_adf_pvalue"))
    return solved.withColumn("equilibrium_gap_norm", zscore("equilibrium_gap", norm, over=W.partitionBy("grp").orderBy("date")))
