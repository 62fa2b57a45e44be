"""Moments of all pairs of columns in one pass over the rows.

A task keeps, for every two columns over the rows where both are known, their number, means, squares and
products about the means (six p x p matrices for p columns), and adds a batch of rows to them by matrix
products.  The rows of these matrices are dealt by their number and merged as they stream, so nothing is held
but p^2 numbers for a task, however many rows and tasks there are.  A batch is centred on its own means before
it is multiplied, and parts are merged by the difference of their means: large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of each column pair (i, j): rows with both, mean of i, mean of j, squares of i, of j, products, about the means.
PARTS = ("n", "mi", "mj", "qi", "qj", "c")
#: What is no more than this share of the squares it is the difference of is rounding; and of n mean^2 over merged parts.
ROUNDING, MERGED = 1e-13, 1e-26


def of_batch(x: np.ndarray) -> np.ndarray:
    """The parts (6 x p x p) of a batch of rows (unknown values are NaN)."""
    known = np.isfinite(x)
    n_own = known.sum(axis=0)
    x = np.where(known, x, 0.0)
    centre = x.sum(axis=0) / np.maximum(n_own, 1)
    x, k = np.where(known, x - centre, 0.0), known.astype(np.float64)
    n = k.T @ k
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, 1 / n, 0.0)
    s = x.T @ k  # of i over rows with j
    mean = s * share
    raw = (x * x).T @ k
    squares = raw - s * mean
    squares[squares <= ROUNDING * raw] = 0.0  # one value in all these rows
    products = x.T @ x - s * s.T * share
    mean = np.where(n > 0, mean + centre[:, None], 0.0)
    return np.stack([n, mean, mean.T, squares, squares.T, products])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The parts of two sets of rows together (any trailing shape)."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    di, dj = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    both = (a[0] > 0) & (b[0] > 0)
    di, dj = np.where(both, di, 0.0), np.where(both, dj, 0.0)
    pick = lambda k, d: np.where(a[0] > 0, a[k] + d * share, b[k])
    return np.stack([n, pick(1, di), pick(2, dj), a[3] + b[3] + di * di * weight, a[4] + b[4] + dj * dj * weight, a[5] + b[5] + di * dj * weight])


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, n, mi, mj, qi, qj, c): one row for each column, by its number; the other columns are arrays over all
    columns j.  Nulls, NaN and infinities are unknown."""
    p = len(columns)
    kind = "i int, " + ", ".join(f"{x} array<double>" for x in PARTS)

    def rows(state: dict[int, np.ndarray]) -> pa.RecordBatch:
        lists = [pa.array([v[k] for v in state.values()], pa.list_(pa.float64())) for k in range(len(PARTS))]
        return pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), *lists], ["i", *PARTS])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = of_batch(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]))
                total = made if total is None else merged(total, made)
        if total is not None:
            yield rows({i: total[:, i] for i in range(p)})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            values = np.stack([batch.column(k + 1).flatten().to_numpy().reshape(-1, p) for k in range(len(PARTS))], axis=1)
            for i, v in zip(batch.column(0).to_pylist(), values):
                state[i] = merged(state[i], v) if i in state else v
        yield rows(state)

    values = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    return values.mapInArrow(partial, kind).repartition("i").mapInArrow(added, kind)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, correlation) for every two columns, both ways and with themselves: Pearson's over the rows where
    both are known, null under two rows or without variance.  Without any rows there are no pairs."""
    names = F.array(*map(F.lit, columns))
    m = pair_moments(df, columns)
    zipped = m.select(F.col("i"), F.posexplode(F.arrays_zip(*PARTS)).alias("j", "v"))
    spread = F.sqrt("v.qi") * F.sqrt("v.qj")
    varies = [F.col(f"v.q{x}") > F.col("v.n") * F.col(f"v.m{x}") * F.col(f"v.m{x}") * MERGED for x in "ij"]
    r = F.when((F.col("v.n") > 1) & varies[0] & varies[1], F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v.c") / spread)))
    return zipped.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.col("v.n").cast("long").alias("n"), r.alias("correlation"), "i", "j")
