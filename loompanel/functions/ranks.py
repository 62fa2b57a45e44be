"""Places in a total order, dealt over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a part; parts at most; sampled rows for each part.  Up to LOCAL rows are held, so that they are made once.
ROWS, PARTS, SAMPLED, LOCAL = 1_000_000, 256, 64, 100_000


def held(df: DataFrame, most: int) -> DataFrame | None:
    """The rows as a table of their own, if there are no more than ``most``."""
    rows = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= most else None


def _part(df: DataFrame, columns: list[str]) -> tuple[Column, int]:
    """Number of the part that a row belongs to (0, 1, ...; parts follow one another in the order) and how many
    there are, by bounds from rows chosen by hash: the same rows give the same parts in every job."""
    parts = min(PARTS, -(-df.count() // ROWS))
    if parts <= 1:
        return F.lit(0), 1
    sample = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(parts * SAMPLED).orderBy(*columns).collect()
    bounds = [sample[i] for i in range(SAMPLED, len(sample), SAMPLED)]
    known = lambda v, c: F.lit(v).cast(df.schema[c].dataType)

    def reached(bound) -> Column:
        """The row does not stand before the bound."""
        out = F.lit(True)
        for c in reversed(columns):
            out = (F.col(c) > known(bound[c], c)) | (F.col(c) == known(bound[c], c)) & out
        return out

    return reduce(lambda a, b: a + b, (F.when(reached(b), 1).otherwise(0) for b in bounds)), len(bounds) + 1


def with_place(df: DataFrame, columns: list[str], name: str = "place") -> DataFrame:
    """``df`` with the number of rows before each row in the order of ``columns`` (nulls first, ties in any order).

    Rows are numbered inside their part, after the rows of the parts before, whose counts (one number for
    each part) are all that the driver holds.  Up to ROWS rows one task numbers them all."""
    few = held(df, min(LOCAL, ROWS))  # distinct tickers or dates mostly are
    part, n = _part(df, columns) if few is None else (F.lit(0), 1)
    df = df if few is None else few
    if n == 1:
        return df.withColumn(name, F.row_number().over(W.orderBy(*columns)) - 1)
    dealt = df.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    before = [sum(sizes.get(k, 0) for k in range(i)) for i in range(n)]
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*columns)) - 1
    return dealt.withColumn(name, inside + F.get(F.array(*(F.lit(b).cast("bigint") for b in before)), F.col("__part"))).drop("__part")


def with_earlier(df: DataFrame, columns: list[str], value: Column, name: str, kind: str = "product") -> DataFrame:
    """``df`` with the product (1 without any) or the maximum (null without any) of ``value`` over all rows before
    each row in the order of ``columns``: inside its part, and over the parts before (one number each)."""
    f = {"product": F.product, "max": F.max}[kind]
    few = held(df, min(LOCAL, ROWS))  # distinct tickers or dates mostly are
    part, n = _part(df, columns) if few is None else (F.lit(0), 1)
    df = df if few is None else few
    order = W.orderBy(*columns) if n == 1 else W.partitionBy("__part").orderBy(*columns)
    dealt = df.withColumns({"__part": part, "__v": value})
    inside = f("__v").over(order.rowsBetween(W.unboundedPreceding, -1))
    totals = {r["__part"]: r.v for r in dealt.groupBy("__part").agg(f("__v").alias("v")).collect()} if n > 1 else {}
    carried: list[float | None] = [None]
    for k in range(n - 1):
        known = [v for v in (carried[-1], totals.get(k)) if v is not None]
        carried.append((known[0] * known[1] if kind == "product" else max(known)) if len(known) == 2 else known[0] if known else None)
    before = F.get(F.array(*(F.lit(v).cast("double") for v in carried)), F.col("__part"))
    one = F.lit(1.0)
    whole = F.coalesce(inside, one) * F.coalesce(before, one) if kind == "product" else F.greatest(inside, before)
    return dealt.withColumn(name, whole).drop("__part", "__v")
