"""Reading and standardising the inputs: bars, macro series, index constituents, fundamentals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loompanel.functions.columns import nn, row_mean
from loompanel.operators.analyse import ohlcv_contract

CONSTITUENT = "struct<Code:string,Name:string,Sector:string,Industry:string,Weight:string>"
STATEMENT = ("totalAssets", "totalLiab", "totalStockholderEquity", "totalCurrentAssets", "totalCurrentLiabilities", "netIncome")
HIGHLIGHTS = ("PERatio", "PEGRatio", "DilutedEpsTTM", "DividendYield", "DividendShare", "MarketCapitalization", "MarketCap")
_QUARTERLY = f"struct<quarterly:map<string,struct<{','.join(f'{c}:string' for c in STATEMENT)}>>>"
FUNDAMENTALS = f"struct<General:struct<MarketCap:string>,Highlights:struct<{','.join(f'{c}:string' for c in HIGHLIGHTS)}>,Financials:struct<Balance_Sheet:{_QUARTERLY},Income_Statement:{_QUARTERLY}>>"


def load_saved(spark: SparkSession, folder: str, tables: tuple[str, ...] = ("stocks", "vix", "commodities", "bond_yields")) -> dict[str, DataFrame]:
    """The saved Parquet tables that exist; ``stocks`` has to."""
    found = {}
    for t in tables:
        try:
            found[t] = spark.read.parquet(f"{folder}/{t}.parquet")
        except Exception as e:  # an absent optional table
            if t == "stocks" or "PATH_NOT_FOUND" not in str(e):
                raise
    return found


def standardise_bars(df: DataFrame, tic: str | None = None) -> DataFrame:
    """Lower-case names; close from the adjusted close where there is one; date as DATE; NaN as null."""
    df = df.withColumnsRenamed({c: c.lower().replace(" ", "_") for c in df.columns})
    if tic is not None:
        df = df.withColumn("tic", F.lit(tic))
    if "adj_close" in df.columns:
        df = df.withColumn("close", F.coalesce(nn("adj_close"), nn("close"))).drop("adj_close")
    return df.select("tic", F.to_date("date").alias("date"), *(nn(c).alias(c) for c in ("open", "high", "low", "close", "volume")))


def union_panels(panels: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)


def mean_series(df: DataFrame, name: str, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """date and the mean of the known values of a row, as ``name``."""
    return df.select("date", row_mean(*columns).alias(name))


def merge_series(series: list[DataFrame]) -> DataFrame:
    """One wide macro table of all dates of any series."""
    return reduce(lambda a, b: a.join(b, "date", "full"), series)


def pivot_series(long: DataFrame, names: list[str], name: str = "name", value: str = "price") -> DataFrame:
    """The same from a long table; one pass over the rows."""
    return long.groupBy("date").pivot(name, names).agg(F.first(value))


def constituents(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """pos, code, name, sector, industry, weight from index documents ``{"Components": {id: {...}}}``."""
    parsed = F.from_json(F.col(json_col), f"struct<Components:map<string,{CONSTITUENT}>>")
    rows = documents.select(F.posexplode(F.map_values(parsed["Components"])).alias("pos", "c"))
    text = lambda n: F.coalesce(F.col(f"c.{n}"), F.lit("")).alias(n.lower())
    return rows.select("pos", text("Code"), text("Name"), text("Sector"), text("Industry"), F.coalesce(F.expr("try_cast(c.Weight AS double)"), F.lit(0.0)).alias("weight"))


def first_codes(members: DataFrame, n: int) -> DataFrame:
    """The first n codes in file order."""
    return members.orderBy("pos", "code").limit(n).select("code")


def filter_constituents(members: DataFrame, include=None, exclude=None, sectors=None, industries=None, min_weight: float | None = None) -> DataFrame:
    """All given conditions hold."""
    out = members
    for column, wanted in (("code", include), ("sector", sectors), ("industry", industries)):
        out = out.where(F.col(column).isin(list(wanted))) if wanted else out
    out = out.where(~F.col("code").isin(list(exclude))) if exclude else out
    return out.where(F.col("weight") >= min_weight) if min_weight is not None else out


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """tic (the file's name) and the parsed document of each JSON file."""
    files = spark.read.text(path, wholetext=True).withColumn("tic", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return files.select("tic", F.from_json("value", FUNDAMENTALS).alias("doc"))


def _number(path: str) -> Column:
    return nn(F.expr(f"try_cast({path} AS double)"))


def market_caps(docs: DataFrame) -> DataFrame:
    """The first known value that is not 0."""
    known = [F.nullif(_number(f"doc.{p}"), F.lit(0.0)) for p in ("Highlights.MarketCapitalization", "Highlights.MarketCap", "General.MarketCap")]
    return docs.select("tic", F.coalesce(*known).alias("market_cap"))


def highlights(docs: DataFrame) -> DataFrame:
    """pe_ratio, peg_ratio, eps and the dividend flag (1 pays, 2 does not)."""
    share, yields = _number("doc.Highlights.DividendShare"), _number("doc.Highlights.DividendYield")
    pays = F.coalesce(yields > 0, F.lit(False)) | (F.coalesce(yields == 0, F.lit(True)) & F.coalesce(share > 0, F.lit(False)))
    return docs.select(
        "tic", _number("doc.Highlights.PERatio").alias("pe_ratio"), _number("doc.Highlights.PEGRatio").alias("peg_ratio"), _number("doc.Highlights.DilutedEpsTTM").alias("eps"), F.when(pays, 1).otherwise(2).cast("tinyint").alias("dividend_flag")
    )


def statements(docs: DataFrame) -> DataFrame:
    """One row for each ticker and quarter of either statement."""
    sheets = []
    for sheet in ("Balance_Sheet", "Income_Statement"):
        rows = docs.select("tic", F.explode(f"doc.Financials.{sheet}.quarterly").alias("d", "s"))
        sheets.append(rows.select("tic", F.expr("try_cast(d AS date)").alias("date"), *(_number(f"s.{c}").alias(f"{sheet}_{c}") for c in STATEMENT)))
    both = sheets[0].join(sheets[1], ["tic", "date"], "full")
    return both.select("tic", "date", *(F.coalesce(f"Balance_Sheet_{c}", f"Income_Statement_{c}").alias(c) for c in STATEMENT))


def read_scoring(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet table of bars."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    ohlcv_contract(df.toDF(*(c.lower() for c in df.columns)))
    return df
