"""Small regressions on one window of numbers, for pandas UDFs."""

from __future__ import annotations

from math import erf, sqrt

import numpy as np

#: The published response surface of the unit-root test with constant (one series).
TAU_MAX, TAU_STAR, TAU_MIN = 2.74, -1.61, -18.83
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    surface = SMALL_P if stat <= TAU_STAR else LARGE_P
    return 0.5 * (1 + erf(sum(c * stat**i for i, c in enumerate(surface)) / sqrt(2)))


def adf(series: np.ndarray, least: int = 10) -> tuple[float | None, float | None]:
    """Augmented Dickey-Fuller statistic and p-value with constant and one lag; (None, None) for short or
    constant series."""
    s = np.asarray(series, dtype=np.float64)
    s = s[np.isfinite(s)]
    if len(s) < least or np.ptp(s) == 0:
        return None, None
    d = np.diff(s)
    y = d[1:]
    x = np.column_stack([s[1:-1], d[:-1], np.ones(len(y))])
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    rest = y - x @ b
    free = len(y) - x.shape[1]
    error = sqrt(max(rest @ rest / free * inverse[0, 0], 0.0)) if free > 0 else 0.0
    if error == 0:
        return None, None
    stat = float(b[0] / error)
    return stat, unit_root_p(stat)


def johansen_vector(levels: np.ndarray, lags: int = 1) -> np.ndarray | None:
    """The first cointegrating vector of a window (rows: time) with constant; its largest entry is positive."""
    n, m = levels.shape
    change = np.diff(levels, axis=0)
    if n - lags - 1 <= m * (lags + 1):
        return None
    now = change[lags:]
    past = np.hstack([change[lags - k : len(change) - k] for k in range(1, lags + 1)]) if lags else np.zeros((len(now), 0))
    before = levels[lags:-1]
    known = np.hstack([past, np.ones((len(now), 1))])
    clean = lambda a: a - known @ np.linalg.lstsq(known, a, rcond=None)[0]
    r0, r1 = clean(now), clean(before)
    return _first_vector(r0.T @ r0 / len(r0), r0.T @ r1 / len(r0), r1.T @ r1 / len(r0))


def _first_vector(s00: np.ndarray, s01: np.ndarray, s11: np.ndarray) -> np.ndarray | None:
    try:
        half = np.linalg.inv(np.linalg.cholesky(s11))
        values, vectors = np.linalg.eigh(half @ s01.T @ np.linalg.solve(s00, s01) @ half.T)
    except np.linalg.LinAlgError:
        return None
    v = half.T @ vectors[:, np.argmax(values)]
    return v * np.sign(v[np.argmax(np.abs(v))])


def johansen_rows(levels: np.ndarray, lags: int = 1) -> np.ndarray:
    """What the moments of ``johansen_from_moments`` are made of, for each row of the levels from number
    lags + 1 on: its change, the level before, the changes before, 1.  Unknown numbers are 0."""
    change = np.diff(levels, axis=0)
    parts = [change[lags:], levels[lags:-1], *(change[lags - k : len(change) - k] for k in range(1, lags + 1)), np.ones((len(change) - lags, 1))]
    return np.nan_to_num(np.hstack(parts), nan=0.0)


def johansen_from_moments(moments: np.ndarray, n: int, m: int, lags: int = 1) -> np.ndarray | None:
    """As ``johansen_vector``, from Z'Z of the n rows Z that ``johansen_rows`` makes of a window of m series."""
    if n <= m * (lags + 1):
        return None
    x, k = moments[: 2 * m], moments[2 * m :]
    try:
        rest = (x[:, : 2 * m] - x[:, 2 * m :] @ np.linalg.solve(k[:, 2 * m :], k[:, : 2 * m])) / n
    except np.linalg.LinAlgError:
        return None
    return _first_vector(rest[:m, :m], rest[:m, m:], rest[m:, m:])
