"""Column helpers shared by the panel operators.

A panel has one row for each ticker and date; ``P()`` orders a ticker's rows by date.  Missing values
are null, never NaN: ``nn`` turns NaN and infinities into null where data enters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def P() -> WindowSpec:
    """A ticker's rows by date.  (A function, as windows need a session, and modules load without one.)"""
    return W.partitionBy("tic").orderBy("date")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trailing(n: int, over: WindowSpec | None = None) -> WindowSpec:
    """The row and the n-1 before it."""
    return (over or P()).rowsBetween(-(n - 1), 0)


def nn(c: str | Column) -> Column:
    """NaN and infinities as null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def td(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(col(c), n).over(P())


def pct(c: str | Column, n: int = 1) -> Column:
    return td(col(c) - lag(c, n), lag(c, n))


def filled(c: str | Column) -> Column:
    """The last known value, at or before the row."""
    return F.last(col(c), ignorenulls=True).over(P().rowsBetween(W.unboundedPreceding, 0))


def at_least(value: Column, counted: str | Column, n: int, k: int, over: WindowSpec | None = None) -> Column:
    """``value`` where the last n rows hold k known values of ``counted``."""
    return F.when(F.count(col(counted)).over(trailing(n, over)) >= k, value)


def rolling(f, c: str | Column, n: int, k: int | None = None, over: WindowSpec | None = None) -> Column:
    """Aggregate f over the last n rows; null under k known values (k: n if not given).

    For one known value nothing is counted: aggregates of unknown values only are null anyway."""
    value = f(col(c)).over(trailing(n, over))
    return value if k == 1 else at_least(value, c, n, n if k is None else k, over)


def extremes(df: DataFrame, largest: bool, column: str, names: dict[int, str]) -> DataFrame:
    """Adds the largest (or least) known value of the last n rows, n by name, from short to long.

    The shortest window slides; a longer one is put together from windows of the one before that end some
    rows earlier (they may overlap), so its cost does not grow with its length."""
    f, best = (F.max, F.greatest) if largest else (F.min, F.least)
    m, name = 0, ""
    for n in sorted(names):
        parts = [lag(name, i * m) for i in range(n // m)] + [lag(name, n - m)] if m else []
        df = df.withColumn(names[n], best(*parts) if parts else rolling(f, column, n, 1))
        m, name = n, names[n]
    return df


def zscore(c: str | Column, n: int, k: int | None = None, over: WindowSpec | None = None) -> Column:
    """(x - mean) / population deviation over the last n rows; null if the deviation is 0."""
    spread = rolling(F.stddev_pop, c, n, k, over)
    return td(col(c) - rolling(F.avg, c, n, k, over), F.nullif(spread, F.lit(0.0)))


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("tinyint")


def zero(c: Column) -> Column:
    return F.coalesce(nn(c), F.lit(0.0))


def row_mean(*columns: str) -> Column:
    """Mean of the known values of a row, null without any."""
    known = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns]
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return td(total, F.nullif(reduce(lambda a, b: a + b, known), F.lit(0)).cast("double"))


def add_if_missing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One projection with the columns that ``df`` doesn't have yet: existing ones win."""
    new = {n: c for n, c in columns.items() if n not in df.columns}
    return df.withColumns(new) if new else df


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison.  Sums differ between engines in the last bits, and prices are
    short decimals that lie on rounding ties: a fixed shift of 0.31 units moves them off."""
    shift = F.lit(0.31 * 10.0**-places)
    return df.select(*(F.round(F.col(f"`{n}`") + shift, places).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))
