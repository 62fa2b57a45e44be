"""The registered queries and their oracle SQL, and small helpers to write that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loompanel.plans.adapters import cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


OVER = "OVER (PARTITION BY tic ORDER BY date)"


def over(n: int, part: str = "tic", order: str = "date") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, c: str, n: int, k: int | None = None) -> str:
    """Aggregate of the last n rows, null under k known values."""
    return f"CASE WHEN count({c}) {over(n)} >= {n if k is None else k} THEN {f}({c}) {over(n)} END"


def lag_(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) {OVER}"


def z(e: str) -> str:
    return f"coalesce({e}, 0)"


def r6(columns: dict[str, str], places: int = 6) -> str:
    return ", ".join(f"round({e} + {0.31 * 10.0**-places!r}, {places}) + 0.0 AS {n}" for n, e in columns.items())


def ti(columns: dict[str, str]) -> str:
    return ", ".join(f"CAST(CASE WHEN {e} THEN 1 ELSE 0 END AS TINYINT) AS {n}" for n, e in columns.items())


def panel_sql(select: str, base: str = "bars", *more: str, using: tuple[str, ...] = ("bars",)) -> str:
    steps = ", ".join([cte(*using), *more])
    return f"WITH {steps} SELECT tic, date, {select} FROM {base}"
