"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loompanel.sources.sinks import materialise, shared_dir  # noqa: F401  the operators take them from here


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(text: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tokenizer_file(path: str) -> str:
    """The local place of a public tokenizer file: an absolute path as it is, else by name."""
    if path.startswith("/"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


#: The map of split_by_ids: bits in one of its rows, bits for each id (a power of two in all), and its largest size (16 MB).
MAP_ROW, MAP_SHARE, MAP_MOST = 1 << 15, 16, 1 << 27


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose id may be among ``ids`` (one column), and rows whose id is not.

    The ids go into a bit map (broadcast by rows of 4 kB) that grows with their number, so that about one
    other row in 16 ends up in the first part, and the rows of neither part move.  An exact step has to
    follow there, and only there texts need to be shuffled.  More ids than a map of MAP_MOST bits can hold are
    joined instead, once for both parts: the rows move once, by their id, and are written with their part (a hot
    id is one row on the side of the ids, so adaptive execution splits its rows).
    """
    name = ids.columns[0]
    count = ids.agg(F.approx_count_distinct(name)).first()[0]
    size = max(1 << 20, 1 << (MAP_SHARE * count - 1).bit_length()) if count else 1 << 20
    if size > MAP_MOST:
        known = ids.select(F.col(name).alias("__lp_known")).where("__lp_known IS NOT NULL").distinct()
        joined = docs.join(known, F.col(id_col) == F.col("__lp_known"), "left").withColumn("__lp_hit", F.col("__lp_known").isNotNull()).drop("__lp_known")
        marked = materialise(joined, "split")
        return marked.where("__lp_hit").select(*docs.columns), marked.where("NOT __lp_hit").select(*docs.columns)
    key = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = ids.select(key(F.col(name)).alias("k")).groupBy(F.floor(F.col("k") / MAP_ROW).alias("__lp_r")).agg(F.bitmap_construct_agg(F.col("k") % MAP_ROW).alias("__lp_bits"))
    keyed = docs.withColumn("__lp_k", key(F.col(id_col)))
    row = F.floor(F.col("__lp_k") / MAP_ROW)
    joined = keyed.withColumn("__lp_row", row).join(F.broadcast(bits), F.col("__lp_row") == F.col("__lp_r"), "left")
    byte = F.conv(F.hex(F.substring("__lp_bits", F.floor(F.col("__lp_k") % MAP_ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__lp_byte, cast(__lp_k % 8 as int)) % 2") == 1, F.lit(False))
    marked = joined.withColumn("__lp_byte", byte).withColumn("__lp_hit", hit)
    return marked.where("__lp_hit").select(*docs.columns), marked.where("NOT __lp_hit").select(*docs.columns)


_TABLES: dict[tuple, object] = {}


def worker_tables(*key, make):
    """What an operator keeps in a Python worker (compiled tables, caches).  Workers are used again by later
    stages; the tables of another operator go first, so that they don't add up."""
    if key not in _TABLES:
        if _TABLES:
            _TABLES.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # give freed memory back, where the C library can
                ctypes.CDLL(None).malloc_trim(0)
        _TABLES[key] = make()
    return _TABLES[key]
