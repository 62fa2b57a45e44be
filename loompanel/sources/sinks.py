"""Writing results, stages and ledgers."""

from __future__ import annotations

import hashlib
import inspect
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none (tests in local mode) a temporary folder is set once.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loompanel-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs do not recompute it, and
    losing an executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/loompanel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Parquet if the path says so, else CSV."""
    df.write.mode("overwrite").parquet(path) if path.endswith(".parquet") else df.write.mode("overwrite").option("header", True).csv(path)


def export_normalised(df: DataFrame, path: str | None = None) -> DataFrame:
    """Without keys and split; every other column has to be a number."""
    out = df.drop("date", "tic", "group", "grp", "split")
    odd = [c for c, t in out.dtypes if t not in NUMERIC]
    if odd:
        raise ValueError(f"not numeric: {odd}")
    if path:
        out.write.mode("overwrite").parquet(path)
    return out


def write_splits(df: DataFrame, path: str) -> None:
    """Also for samples with array columns: one folder for each split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_arrays(df: DataFrame, path: str, keys: list[str], order: tuple[str, ...] = ("tic", "start")) -> None:
    """Samples as one table for each array column and split (``path/key/split=...``); ``order`` columns stay with
    every array, so the tables can be put together again."""
    for key in keys:
        df.select("split", *order, key).write.mode("overwrite").partitionBy("split").parquet(f"{path}/{key}")


def fingerprint(settings: dict, code: tuple[object, ...] = ()) -> str:
    """Of settings and of the source text of the functions and modules that make the stage."""
    texts = [hashlib.sha256(inspect.getsource(c).encode()).hexdigest() for c in code]
    return hashlib.sha256(json.dumps([settings, texts], sort_keys=True, default=str).encode()).hexdigest()[:16]


MARK = "run string, fingerprint string, columns string, rows bigint"


def published(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """The run that the marker of a stage names, if its fingerprint, columns and number of rows are as marked."""
    try:
        marks = spark.read.schema(MARK).json(f"{path}/published").where(F.col("fingerprint") == mark).orderBy("run").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    for m in marks:
        try:
            found = spark.read.parquet(f"{path}/run={m.run}")
        except AnalysisException as e:  # taken away after it was published
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        if json.dumps(found.dtypes) == m.columns and found.count() == m.rows:
            return found
    return None


def stage(spark: SparkSession, folder: str, name: str, settings: dict, make: Callable[[], DataFrame], code: tuple[object, ...] = ()) -> DataFrame:
    """The stage as written before under the same settings and code, or made and written now.

    A run writes to a folder of its own and is published by a marker (one row in one file, which appears whole
    or not at all) that names it, after everything else is written.  A writer that died leaves a folder that no
    marker names: it is never read, and the stage is made again.  Of two writers at once both are whole; the
    first by name is read."""
    mark = fingerprint(settings, code)
    path = f"{folder}/{name}/fingerprint={mark}"
    found = published(spark, path, mark)
    if found is not None:
        return found
    run = uuid.uuid4().hex
    make().write.parquet(f"{path}/run={run}")
    written = spark.read.parquet(f"{path}/run={run}")
    row = (run, mark, json.dumps(written.dtypes), written.count())
    spark.createDataFrame([row], MARK).coalesce(1).write.mode("append").json(f"{path}/published")
    return written


def dataset_metadata(samples: DataFrame, features: list[str], length: int, horizon: int) -> DataFrame:
    """Counts by split with the features and the shape, one row each."""
    return samples.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumns({"features": F.array(*map(F.lit, features)), "length": F.lit(length), "horizon": F.lit(horizon)})


def write_metadata(spark: SparkSession, path: str, features: list[str], length: int, horizon: int, regime: DataFrame | None = None, **more) -> None:
    """One JSON row about a dataset (``path/info``; ``regime``: thresholds as column, stat, value) and the names
    of its features, one in a line (``path/features``)."""
    cuts = {r.column: {} for r in regime.collect()} if regime is not None else {}
    for r in regime.collect() if regime is not None else ():  # a few rows
        cuts[r.column][r.stat] = r.value
    info = {"num_features": len(features), "length": length, "horizon": horizon, "feature_cols": features, "regime_params": cuts, **more}
    spark.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")
    spark.createDataFrame([(f,) for f in features], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/features")


def append_run(spark: SparkSession, path: str, run: dict, blobs: tuple[str, ...] = ()) -> None:
    """One ledger row; nested values as JSON text."""
    row = {k: json.dumps(v) if k in blobs or isinstance(v, dict | list) else v for k, v in run.items()}
    spark.createDataFrame([row]).write.mode("append").parquet(path)


def failure_upsert(ledger: DataFrame, failures: DataFrame) -> DataFrame:
    """Ledger (tic, first_reason, last_reason, first_at, last_at, attempts) with new failures (tic, reason, at)."""
    new = failures.select("tic", F.col("reason").alias("first_reason"), F.col("reason").alias("last_reason"), F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.lit(1).cast("long").alias("attempts"))
    return (
        ledger.unionByName(new)
        .groupBy("tic")
        .agg(F.min_by("first_reason", F.struct("first_at", "first_reason")).alias("first_reason"), F.max_by("last_reason", F.struct("last_at", "last_reason")).alias("last_reason"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("attempts").alias("attempts"))
    )


def without_failed(tickers: DataFrame, ledger: DataFrame, enabled: bool = True) -> DataFrame:
    return tickers.join(ledger.select("tic"), "tic", "left_anti") if enabled else tickers


def failure_removed(ledger: DataFrame, tic: str | None = None) -> DataFrame:
    """The ledger without one ticker, or empty."""
    return ledger.limit(0) if tic is None else ledger.where(~F.col("tic").eqNullSafe(F.lit(tic)))


def failure_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("last_reason").agg(F.count(F.lit(1)).alias("n"), F.min("first_at").alias("oldest"), F.max("last_at").alias("newest"))


def scalars(df: DataFrame) -> DataFrame:
    """The columns that hold no arrays, maps or structs."""
    return df.select(*(c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))))


def report_sinks(tables: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """Each table as CSV with a header or as JSON lines; only scalar columns."""
    for name, df in tables.items():
        w = scalars(df).write.mode("overwrite")
        w.json(f"{path}/{name}") if kind == "json" else w.option("header", True).csv(f"{path}/{name}")
