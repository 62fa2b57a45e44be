"""Panels over the star schema of the test tables.

The same text runs in Spark SQL (table names in braces) and, with plain names, as a common table
expression of the oracle.  Sums go through integer cents, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loompanel.operators.joins import small

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

SQL = {
    "bars": """
SELECT n_name AS tic, r_name AS grp, CAST(l_shipdate AS DATE) AS date,
       min_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       max_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
       sum(l_quantity) AS volume
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY n_name, r_name, CAST(l_shipdate AS DATE)""",
    "weeks": """
SELECT n_name AS tic, r_name AS grp, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) AS close
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY n_name, r_name, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    "calm": """
SELECT n_name AS tic, r_name AS grp, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
       100 + CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS close
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY n_name, r_name, CAST(date_trunc('month', l_shipdate) AS DATE)""",
    "vix": """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100000 AS vix
FROM {orders} GROUP BY CAST(o_orderdate AS DATE)""",
    "commodity": """
SELECT CAST(l_shipdate AS DATE) AS date, p_type AS name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) / 100 AS price
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY CAST(l_shipdate AS DATE), p_type""",
    "yields": """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS y2,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS y10,
       CAST(sum(CAST(round((l_tax + l_discount) * 100) AS BIGINT)) AS DOUBLE) / count(*) AS y30
FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)""",
    "statements": """
SELECT n_name AS tic, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS totalAssets,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS totalLiab,
       CAST(sum(CASE WHEN o_orderstatus <> 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS totalStockholderEquity,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS totalCurrentAssets,
       CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS totalCurrentLiabilities,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1000 AS netIncome
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_name, CAST(date_trunc('quarter', o_orderdate) AS DATE)""",
    "highlights": """
SELECT n_name AS tic, r_name AS grp, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100 AS market_cap, min(c_acctbal) / 1000 AS dividend_yield
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sold(spark: SparkSession, sf_dir: str, date: str, made: dict[str, tuple[str, str]]) -> DataFrame:
    """``lineitem`` by the buyer's nation and region and by ``date``; ``made`` holds an aggregate and what puts its parts
    together for each column.

    Orders get their nation first, so every line is moved once, by its order, with the columns that are asked for;
    names are joined to what is left after grouping."""
    lines, orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    buyers = orders.join(customer, F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_nationkey")
    dated = lines.withColumn("date", F.expr(date)).join(buyers, F.expr("l_orderkey = o_orderkey"))
    grouped = dated.groupBy("c_nationkey", "date").agg(*(F.expr(part).alias(c) for c, (part, _) in made.items()))
    places = nation.join(region, F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.col("n_name").alias("tic"), F.col("r_name").alias("grp"))
    named = grouped.join(places, F.expr("c_nationkey = n_nationkey"))
    return named.groupBy("tic", "grp", "date").agg(*(F.expr(f"{whole}({c})").alias(c) for c, (_, whole) in made.items()))


#: Bars that are held and broadcast: 25 tickers over 27 years of days.
BARS = 250_000
DAY, PRICE = "CAST(l_shipdate AS DATE)", "l_extendedprice / l_quantity"
LINE = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
#: Column, the order that its line is of, and how the line is chosen among those of the order.
ENDS = {"open": ("first", "min_by"), "close": ("last", "max_by")}


def bars(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The panel of ``SQL["bars"]``.  Lines are compared by their order before all else: grouping finds a bar's first
    and last order, and only the lines of these are read with all columns to tell open and close."""
    columns = columns or ("tic", "grp", "date", "open", "high", "low", "close", "volume")
    made = sold(spark, sf_dir, DAY, {"high": (f"max({PRICE})", "max"), "low": (f"min({PRICE})", "min"), "volume": ("sum(l_quantity)", "sum"), "first": ("min(l_orderkey)", "min"), "last": ("max(l_orderkey)", "max")})
    ends = {c: ENDS[c] for c in columns if c in ENDS}
    if not ends:
        return made.select(*columns)
    other = [c for c in columns if c in ("high", "low", "volume")]
    orders = [order for order, _ in ends.values()]
    found = small(made.select("tic", "grp", "date", *other, *orders), BARS)
    found = found.select("tic", "grp", "date", *other, F.explode(F.array_distinct(F.array(*orders))).alias("end"))
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.expr(DAY))
    lines = lines.join(found, (F.col("l_orderkey") == F.col("end")) & F.col("day").eqNullSafe(F.col("date")))
    chosen = (F.expr(f"{f}({PRICE}, {LINE})").alias(c) for c, (_, f) in ends.items())
    return lines.groupBy("tic", "grp", "date").agg(*(F.first(c).alias(c) for c in other), *chosen).select(*columns)


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of ``SQL["weeks"]``."""
    made = sold(spark, sf_dir, "CAST(date_trunc('week', l_shipdate) AS DATE)", {"cents": ("sum(CAST(round(l_extendedprice * 100) AS BIGINT))", "sum"), "volume": ("sum(l_quantity)", "sum")})
    return made.select("tic", "grp", "date", F.expr("CAST(cents AS DOUBLE) / volume").alias("close"))


def calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of ``SQL["calm"]``."""
    made = sold(spark, sf_dir, "CAST(date_trunc('month', l_shipdate) AS DATE)", {"cents": ("sum(CAST(round(l_discount * 100) AS BIGINT))", "sum"), "n": ("count(*)", "sum")})
    return made.select("tic", "grp", "date", F.expr("100 + CAST(cents AS DOUBLE) / n").alias("close"))


def view(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the panels of ``SQL``, or some of its columns."""
    if name == "bars":
        return bars(spark, sf_dir, *columns)
    if name in ("weeks", "calm"):
        df = {"weeks": weeks, "calm": calm}[name](spark, sf_dir)
    else:
        df = spark.sql(SQL[name], **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in SQL[name]})
    return df.select(*columns) if columns else df


def cte(*names: str) -> str:
    """The panels as the beginning of a WITH clause."""
    plain = {t: t for t in TABLES}
    return ", ".join(f"{n} AS ({SQL[n].format(**plain)})" for n in names)
