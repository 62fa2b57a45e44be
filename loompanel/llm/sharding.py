"""Two-pass external shuffle.

Pass one scatters the records into memory-sized buckets by a seeded hash of id and text: one Spark
shuffle, whose files are the buckets.  Pass two reads the buckets one after another, puts each into
a fixed order, permutes it by a seeded Fisher-Yates shuffle and writes it to the shared folder.
Bucket after bucket, the written records are one random permutation of the table; it is dealt to
the shards like cards (position mod shards), so shard sizes differ by one row at most, whatever the
sizes of the texts or of groups of copies.

What is held in memory is one bucket of a task (``bucket_bytes`` of text on average; a single text
larger than that is a bucket of its own size).  A task takes several buckets, one after another, when
there are more than ``PARTITIONS``.  The result depends on the seed, the bucket count and the rows
only, not on the order in which tasks or machines deliver them.  Rows equal in id and text would all fall
into one bucket: where they overfill it they are numbered, and each ``COPIES`` of them are dealt anew.

Nulls: a null text is scattered and counted as empty and stays null in the result; null ids are
scattered like any other id.  Repeated rows are dealt one by one; rows equal in id and text can
stand for each other.  Input columns keep their names and values; ``shard`` and ``slot`` replace
input columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loompanel.llm.common import materialise, text_of

#: Tasks of the scatter at most; equal rows that stay together at most, where they overfill a bucket.
PARTITIONS, COPIES = 50_000, 1000
#: Offsets of up to so many buckets are broadcast (16 bytes each); beyond, they are joined by sorting.
BROADCAST_BUCKETS = 500_000
#: Buckets in a block of the two-level running sum of bucket sizes.
BLOCK = 4096


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0..n-1: each place, from the last to the second, swaps with a drawn one."""
    order = list(range(n))
    draws = np.random.default_rng(seed).random(max(n - 1, 0))
    for i in range(n - 1, 0, -1):
        j = int(draws[i - 1] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _permuted(seed: int):
    def flush(parts: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        n = table.num_rows
        order = fisher_yates(n, (seed << 32) ^ bucket)
        step = max(1, ceil(n / max(1, ceil(table.nbytes / (4 << 20)))))
        for at in range(0, n, step):
            part = table.take(pa.array(order[at : at + step])).combine_chunks()
            part = part.append_column("__lp_pos", pa.array(np.arange(at, at + part.num_rows), pa.int64()))
            yield from part.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column("__lp_bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and keys[a] != now:
                    yield from flush(held, int(now))
                    held = []
                now = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held, int(now))

    return run


def _copies_apart(keyed: DataFrame, bucket: Callable[[Column], Column], size: Column, bucket_bytes: int, id_col: str) -> DataFrame:
    """``keyed`` with ``__lp_salt``: 0, or for rows equal in id and text that would overfill a bucket the number of the
    row among them, by COPIES.  Counts of buckets tell where to look for such rows; no other rows move for it.
    Which of the equal rows gets which number does not matter, and the numbers are the same in any layout."""
    none = F.lit(0).cast("long")
    full = keyed.groupBy(bucket(none).alias("__lp_b")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    full = materialise(full.where((F.col("n") > COPIES) & (F.col("size") > 2 * bucket_bytes)).select("__lp_b"), "full")
    if full.isEmpty():
        return keyed.withColumn("__lp_salt", none)
    inside = keyed.select(F.col(id_col).alias("__lp_id"), F.col("__lp_tie").alias("__lp_same"), bucket(none).alias("__lp_b")).join(full, "__lp_b", "left_semi")
    hot = materialise(inside.groupBy("__lp_id", "__lp_same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES).drop("n"), "hot")
    marked = keyed.join(hot, F.col(id_col).eqNullSafe(F.col("__lp_id")) & (F.col("__lp_tie") == F.col("__lp_same")), "left")
    cold = marked.where("__lp_same IS NULL").withColumn("__lp_salt", none)
    rows = materialise(marked.where("__lp_same IS NOT NULL").withColumn("__lp_part", F.spark_partition_id()), "hot-rows")
    keys = ["__lp_id", "__lp_same", "__lp_part"]
    earlier = W.partitionBy("__lp_id", "__lp_same").orderBy("__lp_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    offsets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("__lp_from", F.coalesce(F.sum("n").over(earlier), none))
    offsets = offsets.select(F.col("__lp_id").alias("__lp_i"), F.col("__lp_same").alias("__lp_s"), F.col("__lp_part").alias("__lp_p"), "__lp_from")
    numbered = rows.withColumn("__lp_n", F.row_number().over(W.partitionBy(*keys).orderBy("__lp_part")) - 1)
    numbered = numbered.join(offsets, F.col("__lp_id").eqNullSafe(F.col("__lp_i")) & (F.col("__lp_same") == F.col("__lp_s")) & (F.col("__lp_part") == F.col("__lp_p")))
    salted = numbered.withColumn("__lp_salt", F.floor((F.col("__lp_from") + F.col("__lp_n")) / COPIES))
    return cold.select(*keyed.columns, "__lp_salt").union(salted.select(*keyed.columns, "__lp_salt"))


def external_shuffle(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 17,
    bucket_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards-1) and ``slot`` (place in the shard, from 0), as written
    to the shared folder."""
    docs = docs.drop("shard", "slot")
    text = text_of(text_col)
    keyed = docs.withColumn("__lp_tie", F.xxhash64(text))
    size = F.octet_length(text) + F.lit(1).cast("long")
    n_buckets = max(1, ceil((keyed.agg(F.sum(size)).first()[0] or 0) / bucket_bytes))
    bucket = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), "__lp_tie", salt), F.lit(n_buckets).cast("long"))
    keyed = _copies_apart(keyed, bucket, size, bucket_bytes, id_col)
    keyed = keyed.withColumn("__lp_bucket", bucket(F.col("__lp_salt"))).drop("__lp_salt")
    n_tasks = min(n_buckets, PARTITIONS)
    scattered = keyed.repartitionById(n_tasks, (F.col("__lp_bucket") % n_tasks).cast("int")).sortWithinPartitions("__lp_bucket", id_col, "__lp_tie").drop("__lp_tie")
    schema = T.StructType([*scattered.schema.fields, T.StructField("__lp_pos", T.LongType())])
    written = materialise(scattered.mapInArrow(_permuted(seed), schema), "shards")

    counts = written.groupBy("__lp_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("__lp_bucket") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))  # one row for 4096 buckets: small enough for one task
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("__lp_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("inside", inside).join(blocks, "block").select("__lp_bucket", (F.col("base") + F.col("inside")).alias("__lp_from"))
    if n_buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    place = F.col("__lp_from") + F.col("__lp_pos")
    return written.join(offsets, "__lp_bucket").select(
        *docs.columns,
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        ((place - F.pmod(place, F.lit(n_shards))) / n_shards).cast("long").alias("slot"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order within each file."""
    shuffled.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
