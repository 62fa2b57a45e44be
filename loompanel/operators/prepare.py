"""Targets, splits, folds, encodings, regimes and scalers: fitted on the training rows, applied to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.functions.columns import P, nn, td
from loompanel.functions.quantiles import exact_quantiles
from loompanel.functions.ranks import with_place
from loompanel.operators.joins import small

SKIP = ("day", "month", "dayofweek", "dividend_flag", "regime_id")
IDS = ("tic", "date", "grp", "group", "split", "tic_id", "group_id", "target")


def by_tickers(df: DataFrame, tickers: list[str] | DataFrame) -> DataFrame:
    return df.where(F.col("tic").isin(tickers)) if isinstance(tickers, list) else df.join(tickers.select("tic"), "tic", "left_semi")


def samples_by_ids(samples: DataFrame, ids: list[int]) -> DataFrame:
    """By the first ticker id of a sample's array."""
    return samples.where(F.col("stock_id")[0].isin(ids))


def trailing_years(df: DataFrame, years: int) -> DataFrame:
    """Rows of the last 365 * years days before the latest date."""
    last = df.agg(F.max("date")).first()[0]
    return df.where(F.col("date") >= F.date_sub(F.lit(last), 365 * years)) if last is not None else df


def sectors(df: DataFrame, mapping: DataFrame | None, name: str = "group") -> DataFrame:
    """The ticker's sector of ``mapping`` (tic, sector); Unknown without one."""
    if mapping is None:
        return df.withColumn(name, F.lit("Unknown"))
    found = small(mapping.select("tic", F.col("sector").alias(name)))
    return df.join(found, "tic", "left").withColumn(name, F.coalesce(F.col(name), F.lit("Unknown")))


def target(df: DataFrame, horizon: int = 5, squash: float | None = None) -> DataFrame:
    """Percent change of the close over the next bars; rows without future go.  Squashed by tanh if asked."""
    change = td(F.lead("close", horizon).over(P()) - F.col("close"), F.col("close")) * 100
    out = df.withColumn("target", change).where(F.col("target").isNotNull())
    return out.withColumn("target", squashed(F.col("target"), squash)) if squash else out


def squashed(c: Column, threshold: float) -> Column:
    return F.tanh(c / max(threshold, 1e-8))


def unsquashed(c: Column, threshold: float) -> Column:
    return F.atanh(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), c))) * threshold


def fill_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.coalesce(nn("target"), F.lit(0.0)))


def ranked_dates(df: DataFrame) -> DataFrame:
    """Distinct dates with their place from 0."""
    return with_place(df.select("date").where("date IS NOT NULL").distinct(), ["date"])


def by_date(df: DataFrame) -> DataFrame:
    """A table of one row for each date, for broadcast: the type DATE holds 3.7 million days at most, so its
    size is bounded without counting.  Other keys are left to adaptive execution."""
    return F.broadcast(df) if df.schema["date"].dataType.typeName() == "date" else df


def date_split(df: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """split = train, val or test by the rank of the date; bounds are cut down in floating point."""
    dates = ranked_dates(df).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    a, b = (F.floor(F.col("n") * F.lit(float(x))) for x in (train, train + val))
    named = F.when(F.col("place") < a, "train").when(F.col("place") < b, "val").otherwise("test")
    return df.join(by_date(dates.select("date", named.alias("split"))), "date")


def _folds(df: DataFrame, ranges: list[tuple[int, str, int, int]]) -> DataFrame:
    """Rows of each (fold, role, first place, end place); folds are few, dates are a small table."""
    if not ranges:
        return df.limit(0).withColumns({"fold": F.lit(0), "role": F.lit("")})
    spans = df.sparkSession.createDataFrame(ranges, "fold int, role string, a int, b int")
    spans = spans.select("fold", "role", F.explode(F.expr("CASE WHEN b > a THEN sequence(a, b - 1) END")).alias("place"))
    dates = ranked_dates(df).join(F.broadcast(spans), "place").select("date", "fold", "role")
    return df.join(small(dates), "date")


def walk_forward(df: DataFrame, train: int, gap: int, val: int, step: int) -> DataFrame:
    """Rolling folds of fixed width over the dates."""
    n = ranked_dates(df).count()
    ranges, fold, start = [], 0, 0
    while start + train + gap + val <= n:
        ranges += [(fold, "train", start, start + train), (fold, "val", start + train + gap, start + train + gap + val)]
        fold, start = fold + 1, start + step
    return _folds(df, ranges)


def purged_folds(df: DataFrame, splits: int, gap: int, least_train: int) -> DataFrame:
    """Expanding folds; the last validation part takes what is left."""
    n = ranked_dates(df).count()
    size = (n - least_train - gap) // splits
    if size < 1:
        raise ValueError("too few dates for these folds")
    ranges = []
    for i in range(splits):
        end = least_train + i * size
        ranges += [(i, "train", 0, end), (i, "val", end + gap, n if i == splits - 1 else end + gap + size)]
    return _folds(df, ranges)


def fold_bounds(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def label_ids(df: DataFrame, column: str) -> DataFrame:
    """(column, id): place of each distinct value in sorted order, from 0.  One row for each value."""
    return with_place(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "id")


def encode(df: DataFrame, ids: DataFrame, column: str, name: str) -> DataFrame:
    """Unknown values get -1."""
    return df.join(small(ids.select(column, F.col("id").alias(name))), column, "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("int"))


def extend_ids(ids: DataFrame, df: DataFrame, column: str, order: str = "date") -> DataFrame:
    """The map with new values numbered on, by first appearance (then by value)."""
    new = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("o")).join(ids.select(column), column, "left_anti")
    start = ids.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    numbered = with_place(new, ["o", column], "id")
    return ids.unionByName(numbered.select(column, (F.col("id") + start + 1).cast("int").alias("id")))


def fit_regime(df: DataFrame, column: str, cuts: tuple[float, ...] = (1 / 3, 2 / 3)) -> list[float]:
    """Exact quantiles of the training rows."""
    found = exact_quantiles(df.where("split = 'train'"), [column], cuts)[column]
    return [x for x in found if x is not None]


def regime(df: DataFrame, column: str, cuts: list[float], default: int = 1, name: str = "regime_id") -> DataFrame:
    """How many thresholds the value reaches; ``default`` for null."""
    reached = sum((F.when(F.col(column) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return df.withColumn(name, F.when(F.col(column).isNull(), default).otherwise(reached).cast("int"))


def regime_params(spark, column: str, cuts: list[float], default: int = 1) -> DataFrame:
    """Thresholds as a table (column, stat, value), and back by restore_regime."""
    rows = [(column, f"cut_{i}", float(c)) for i, c in enumerate(cuts)] + [(column, "default", float(default))]
    return spark.createDataFrame(rows, "column string, stat string, value double")


def restore_regime(params: DataFrame) -> tuple[list[float], int]:
    rows = {r.stat: r.value for r in params.collect()}
    return [rows[k] for k in sorted(rows) if k.startswith("cut_")], int(rows["default"])


def fill_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(nn(c), F.lit(0.0)) for c in columns})


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in IDS and c not in SKIP]


def fit_scaler(df: DataFrame, columns: list[str], method: str = "robust") -> DataFrame:
    """(column, center, scale) from the training rows; a scale of 0 becomes 1."""
    train = df.where("split = 'train'")
    if method == "robust":
        found = exact_quantiles(train, columns, (0.25, 0.5, 0.75))
        rows = [(c, q[1], 1.0 if q[0] is None or q[2] == q[0] else q[2] - q[0]) for c, q in found.items()]
        return df.sparkSession.createDataFrame(rows, "column string, center double, scale double")

    def stats(c: str) -> Column:
        x = F.col(c)
        if method == "standard":
            center, scale = F.avg(x), F.stddev_pop(x)
        elif method == "minmax":
            center, scale = F.min(x), F.max(x) - F.min(x)
        else:
            center, scale = F.min(x), F.lit(1.0)
        scale = F.when(F.abs(scale) > 0, scale).otherwise(F.lit(1.0))
        return F.struct(F.lit(c).alias("column"), center.cast("double").alias("center"), scale.cast("double").alias("scale"))

    return train.agg(F.array(*map(stats, columns)).alias("s")).select(F.explode("s").alias("p")).select("p.*")


def scale(df: DataFrame, params: DataFrame, method: str = "robust", inference: bool = False, offset: float = 1.0) -> DataFrame:
    """(x - center) / scale; at inference 1e-8 is added to the scale.  log: log1p(max(x - min + offset, 0))."""
    made = {}
    for r in params.collect():  # one row for each column
        x = F.col(r.column) - F.lit(r.center)
        made[r.column] = F.log1p(F.greatest(x + offset, F.lit(0.0))) if method == "log" else x / F.lit(r.scale + (1e-8 if inference else 0.0))
    return df.withColumns(made)


def fit_inverse(pairs: DataFrame, raw: str = "raw", norm: str = "norm") -> DataFrame:
    """One row: kind (affine or log), a, b and the largest residual of the better inverse."""
    p = pairs.select(F.col(raw).alias("y"), F.col(norm).alias("x")).where("y IS NOT NULL AND x IS NOT NULL")
    shift = exact_quantiles(p.select((F.col("y") - F.expm1("x")).alias("m")), ["m"], (0.5,))["m"][0]
    f = p.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.lit(shift).cast("double").alias("m"))
    r = p.join(F.broadcast(f)).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("m").alias("m"), F.max(F.abs(F.col("a") * F.col("x") + F.col("b") - F.col("y"))).alias("ea"), F.max(F.abs(F.expm1("x") + F.col("m") - F.col("y"))).alias("el"))
    log = F.col("el") < F.col("ea")
    return r.select(F.when(log, "log").otherwise("affine").alias("kind"), F.when(log, F.lit(1.0)).otherwise(F.col("a")).alias("a"), F.when(log, F.col("m")).otherwise(F.col("b")).alias("b"), F.least("el", "ea").alias("residual"))


def apply_inverse(c: Column, kind: str, a: float, b: float) -> Column:
    return F.expm1(c) + b if kind == "log" else c * a + b
