"""Whitening of embeddings on their leading principal components.

*Input.*  Rows whose vector is null, or holds null or non-finite entries, are left out; so are rows whose
vector has not the most frequent length (of equally frequent ones the greatest).  Each entry c becomes the
long floor(256 c), so that sums are exact.  The fit list has each different vector once; copies are
combined on the map side before anything moves.

*Covariance.*  Two passes over the fit list: exact sums, then products of the centred vectors.  A task adds
up one matrix for its rows; the rows of these matrices are dealt by their number and added as they stream,
so what a task or the driver holds depends on the dimensions only (d^2 numbers).

*Components.*  On the driver, d x d: Householder reflections make the covariance tridiagonal; Sturm counts
(how many eigenvalues lie below a value) are bisected for the leading eigenvalues; inverse iteration gives
their vectors, and vectors of close eigenvalues are made orthogonal to each other in every step; the
reflections turn them back.

*Projection.*  The k vectors are broadcast with the mean; row by row, no shuffle.

Fewer dimensions than ``k`` give so many components.  A component without variance (an eigenvalue of no more
than rounding) gives ``whitened`` null, a table without any variance ``explained`` null; ``identity_error``
is over the components that have variance, null if there is none.  ``deviation`` is null where the exact
value does not fit into a long.  Entries must stay within 2^31 after the factor.  Repeated rows are kept,
a null id is carried through, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import materialise

SCALE = 256
EPS = np.finfo(np.float64).eps


# ---- eigenvalues and vectors of a symmetric matrix -------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of the matrix after Householder reflections, and these (unit vectors)."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    mirrors = []
    for j in range(d - 2):
        x = a[j + 1 :, j]
        size = np.abs(x).max()
        v = np.zeros(d)
        if size > 0:
            x = x / size
            v[j + 1 :] = x
            v[j + 1] += np.copysign(np.linalg.norm(x), x[0])
            v /= np.linalg.norm(v)
            p = a @ v
            w = 2 * (p - (v @ p) * v)
            a -= np.outer(v, w) + np.outer(w, v)
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value how many eigenvalues of the tridiagonal matrix are smaller: the number of negative
    pivots of its shifted factorisation."""
    least = EPS * EPS * (np.abs(diagonal).max() + (np.abs(off).max() if len(off) else 0.0))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(np.int64)
    for a, b in zip(diagonal[1:], off):
        pivot = a - at - b * b / np.where(np.abs(pivot) < least, np.copysign(least, pivot), pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until no double lies between its bounds."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    pad = EPS * np.abs([low, high]).max() + 1e-300
    low, high = low - pad, high + pad
    wanted = d - np.arange(1, k + 1)  # so many eigenvalues are smaller than the one sought
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_count(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - value) y = b by elimination with exchange of neighbouring rows."""
    d = len(diagonal)
    tiny = EPS * (np.abs(diagonal).max() + (np.abs(off).max() if d > 1 else 0.0))
    a, upper, second = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * d
    lower, swapped = off.tolist(), [False] * d
    for i in range(d - 1):
        if abs(lower[i]) > abs(a[i]):
            swapped[i] = True
            a[i], lower[i] = lower[i], a[i]
            upper[i], a[i + 1] = a[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
        a[i] = a[i] or tiny
        lower[i] /= a[i]
        a[i + 1] -= lower[i] * upper[i]
        upper[i + 1] -= lower[i] * second[i]
    a[d - 1] = a[d - 1] or tiny

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i in range(d - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= lower[i] * y[i]
        for i in range(d - 1, -1, -1):
            y[i] = (y[i] - (upper[i] * y[i + 1] if i + 1 < d else 0.0) - (second[i] * y[i + 2] if i + 2 < d else 0.0)) / a[i]
        return np.array(y)

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (rows) of falling eigenvalues.  Vectors of a cluster (neighbours closer than 1e-3 of
    the largest) are made orthogonal to those before them in every round."""
    d, scale = len(diagonal), np.abs(values).max()
    draw = np.random.default_rng(7)
    made: list[np.ndarray] = []
    cluster = 0
    shift = np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * scale:
            cluster = i
        shift = min(value, shift - 8 * EPS * scale)  # equal values get shifts of their own
        solve = _solver(diagonal, off, shift)
        v = draw.standard_normal(d)
        for _ in range(rounds):
            v = solve(v / np.linalg.norm(v))
            v /= np.abs(v).max()
            for _ in range(2):
                for u in made[cluster:i]:
                    v = v - (u @ v) * u
        made.append(v / np.linalg.norm(v))
    return np.array(made)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors (rows)."""
    scale = np.abs(matrix).max()
    if not scale:
        return np.zeros(k), np.eye(k, len(matrix))
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for v in reversed(mirrors):
        vectors = vectors - 2 * np.outer(vectors @ v, v)
    return values * scale, vectors


# ---- the distributed part --------------------------------------------------------------------------


def _matrix(column: pa.Array, d: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind, copy=False)


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, x (array of longs) for the usable rows."""
    c = F.col(vec_col)
    good = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(c.isNotNull() & good)
    return rows.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))


def _summed_products(fit: DataFrame, made: Callable[[pa.Array], np.ndarray], width: int) -> np.ndarray:
    """The sum of y y' over all rows x of the fit list, y = made(x)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = made(batch.column(0))
            total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), width)):
                rows[i] = rows[i] + v if i in rows else v
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["i", "v"])

    kind = "i int, v array<double>"
    total = np.zeros((width, width))
    for r in fit.select("x").mapInArrow(partial, kind).repartition("i").mapInArrow(added, kind).collect():
        total[r.i] = r.v
    return total


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # falling
    vectors: np.ndarray  # rows
    trace: float
    error: float | None  # of whitened's covariance over the fit list

    @property
    def live(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.values > len(self.sums) * 4 * EPS * max(self.trace, 0.0)


def fit_whitening(fit: DataFrame, k: int = 4) -> Whitening | None:
    """From the fit list (column x, each vector once, all of one length); None if it is empty."""
    sizes = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    if not sizes:
        return None
    d, n, sums = len(sizes), sizes[0].n, [r.s for r in sizes]
    mean = np.array([s / n for s in sums])
    covariance = _summed_products(fit, lambda x: _matrix(x, d) - mean, d) / n
    values, vectors = leading_components(covariance, min(k, d))
    out = Whitening(n, sums, values, vectors, float(np.trace(covariance)), None)
    if out.live.any():
        factors = (vectors[out.live] / np.sqrt(values[out.live])[:, None]).T
        whitened = _summed_products(fit, lambda x: (_matrix(x, d) - mean) @ factors, factors.shape[1]) / n
        out.error = float(np.abs(whitened - np.eye(len(whitened))).max())
    return out


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row (id, x) and component."""
    kind = rows.schema["id"].dataType.simpleString()
    d, k, n = len(model.sums), len(model.values), model.n
    sums, mean = np.array(model.sums, dtype=np.int64), np.array([s / n for s in model.sums])
    live = model.live
    factors = (model.vectors / np.sqrt(np.where(live, model.values, 1.0))[:, None]).T
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), d, np.int64)
            gap = n * x - sums
            size = (gap.astype(np.float64) ** 2).sum(axis=1)
            with np.errstate(over="ignore"):
                deviation = (gap * gap).sum(axis=1)
            whitened = (x - mean) @ factors
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, dtype=np.int64)),
                pa.array(np.repeat(deviation, k), mask=np.repeat(size > 9.2e18, k)),
                pa.array(whitened.ravel(), mask=np.tile(~live, m)),
                pa.array(explained * m, pa.float64()),
                pa.array([model.error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each usable row and component: id, component (from 1, by falling eigenvalue), n (fit list), deviation
    (sum of (n x - S)^2, exact), whitened (the centred vector on the component, over the eigenvalue's root),
    explained (share of the variance), identity_error (largest entry of whitened's covariance less identity)."""
    rows = quantised(df, id_col, vec_col)
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (usual.d if usual else -1))
    fit = materialise(rows.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, k)
    if model is None:
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, None)
        rows = rows.limit(0)
    return projected(rows, model).withColumnRenamed("id", id_col)
