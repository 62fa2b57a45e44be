"""Exact deduplication by 128-bit content hash with a byte comparison inside every hash group.

Only built-in functions.

1. ``group by hash``: which content hashes occur more than once.  16 bytes for each row move, combined on
   the map side.  Rows of other hashes are groups of their own and are done.
2. ``group by hash, text`` over the rows of repeated hashes - the text in the key is the byte
   comparison, so two texts that collide form two classes.  Copies are combined on the map side, which
   turns a group that holds a third of all rows into one row for each map task before anything moves.
3. These rows (id and two hashes, no text) join their classes.  A hot class is one row on the class
   side; adaptive execution splits the row side.  Rows find their class by the content hash and the
   text's SHA-256, so texts that collide in the content hash still part.

Nulls count as the empty text, repeated rows each get a row, null ids are carried through (a group
with only null ids keeps them all out: ``kept`` is false and ``keep_id`` null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import materialise, split_by_ids, text_of


def content_hash(text: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep``: the smallest or the largest id of a group stays (``min``, ``max``).
    """
    chosen = {"min": F.min, "max": F.max}[keep]
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("__lp_id"), text.alias("__lp_text"))
    rows = rows.withColumn("__lp_h", hash_of(F.col("__lp_text")))
    repeated = materialise(rows.groupBy("__lp_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__lp_h"), "repeated")
    maybe, alone = split_by_ids(rows, repeated, "__lp_h")
    sha = F.unhex(F.sha2(F.col("__lp_text"), 256)).alias("__lp_s")
    # only fixed-width values in the aggregate, so that it stays a hash aggregate
    classes = (
        maybe.groupBy("__lp_h", "__lp_text")
        .agg(chosen("__lp_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("__lp_h", sha, "keep_id", "group_size")
    )
    grouped = maybe.select("__lp_id", "__lp_h", sha).join(classes, ["__lp_h", "__lp_s"]).select("__lp_id", "keep_id", "group_size", "__lp_s")
    single = alone.select("__lp_id", F.col("__lp_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), sha)
    return grouped.union(single).select(
        F.col("__lp_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("__lp_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("__lp_s")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts: that of the chosen id, or any one of
    several rows with equal text and id.  Same columns.

    Only rows that may have to go (their id is dropped or repeated) are shuffled again, dealt by id and
    hash, so no group meets in one task.
    """
    found = materialise(exact_duplicates(docs, id_col, text_col, keep).select(F.col(id_col).alias("__lp_id"), "keep_id", "text_sha256"), "exact")
    going = F.max((~F.col("__lp_id").eqNullSafe(F.col("keep_id"))).cast("int")) == 1
    doubtful = found.groupBy("__lp_id").agg((going | (F.count(F.lit(1)) > 1)).alias("d")).where("d")
    maybe, sure = split_by_ids(docs, doubtful.select("__lp_id"), id_col)
    stay = found.where(F.col("__lp_id").eqNullSafe(F.col("keep_id"))).select("__lp_id", F.col("text_sha256").alias("__lp_s")).distinct()
    rows = maybe.withColumn("__lp_h", F.sha2(text_of(text_col), 256))
    kept = rows.join(stay, (rows["__lp_h"] == stay["__lp_s"]) & rows[id_col].eqNullSafe(stay["__lp_id"]), "left_semi")
    return sure.union(kept.dropDuplicates([id_col, "__lp_h"]).drop("__lp_h"))
