"""Near-duplicates by SimHash, compared exactly in tiles.

*Fingerprint.*  Each three-word shingle of a text, repeats included, is hashed to 64 bits (XXH64, seed 42);
a bit of the fingerprint is 1 if it is set in more than half the hashes.  Row by row, no shuffle.

*Tiles.*  Equal fingerprints are one node.  A tile holds the fingerprints with the same population counts of
their four 16-bit quarters; two fingerprints at distance r differ by r at most in the sum of these four
differences, so a tile meets only tiles within the radius and all other tile pairs are skipped.  There are
17^4 tiles at most, so the table of their sizes is a broadcast of bounded size.  A fingerprint goes once to
its own tile and once to each neighbour of smaller number; large tiles are cut into blocks, and the long
lists of their neighbours into lanes, so that a unit of work has about BLOCK + LANE fingerprints at most.
Within a unit numpy takes exclusive-or and bit counts of all fingerprints of the block against all others:
nothing is missed.  The cost is quadratic in the number of different fingerprints, as the method is exact.

*Links.*  A unit gives one link for each fingerprint that joins a smaller one of the unit, not one for each
pair, so a dense group of copies gives few rows.  Components follow as in ``minhash.components``.

A text of one or two words is one shingle of all its words, one without words has fingerprint zero and is
linked like any other.  Nulls count as empty texts, repeated rows each get a row; a null id is carried
through and takes no part in the smallest id (component null if all ids are null).  Rows of one id with
several texts are not joined by the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import materialise, text_of
from loompanel.llm.minhash import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shingles hashed at a time.
PIECE = 1 << 16
#: Fingerprints of a unit's own block and of its lane of neighbours, and comparisons made at a time.
BLOCK, LANE, CELLS = 1 << 14, 1 << 14, 1 << 18

_AT = np.arange(8, dtype=np.uint16) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(k, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    ends = ends[k - 1 :].tolist()
    digest, n = xxhash.xxh64_digest, len(starts)
    counts = np.zeros(8 * 256, dtype=np.int64)
    for at in range(0, n, PIECE):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE])])
        counts += np.bincount((np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8) + _AT).ravel(), minlength=8 * 256)
    ones = counts.reshape(8, 256).astype(np.float64) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long), row by row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def tile_of(fp: Column) -> Column:
    """The tile as one number; a step of d in the count of quarter k changes it by d * 32^k."""
    quarters = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return sum(((q + 4) * F.lit(32**k) for k, q in enumerate(quarters)), F.lit(0)).cast("int")


def steps(radius: int = RADIUS) -> list[int]:
    """Zero and the steps to half of the tiles within the radius: of each two neighbours one has the step."""
    near = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    return sorted(d for s in near if (d := sum(x * 32**k for k, x in enumerate(s))) >= 0)


def _units(nodes: DataFrame, radius: int) -> DataFrame:
    """(unit, side, fp): side 0 are the fingerprints of the unit's own block, side 1 those they meet."""
    held = nodes.select("fp", tile_of(F.col("fp")).alias("tile"))
    tiles = materialise(held.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), "tiles")
    step = F.explode(F.array(*map(F.lit, steps(radius))))
    met = tiles.select("n", "tile", step.alias("d")).groupBy((F.col("tile") - F.col("d")).alias("home")).agg(F.sum("n").alias("others"))
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    plan = tiles.join(met, F.col("tile") == F.col("home")).select("home", parts("n", BLOCK).alias("blocks"), parts("others", LANE).alias("lanes"))
    plan = F.broadcast(materialise(plan, "plan"))
    unit = lambda block, lane: (F.col("home").cast("long") * F.lit(1 << 40) + block * F.lit(1 << 20) + lane).alias("unit")
    block, lane = F.expr("pmod(xxhash64(fp), blocks)"), F.expr("pmod(xxhash64(fp, 1), lanes)")
    own = held.withColumnRenamed("tile", "home").join(plan, "home").withColumn("lane", F.explode(F.expr("sequence(0, lanes - 1)")))
    others = held.withColumn("d", step).withColumn("home", F.col("tile") - F.col("d")).join(plan, "home")
    # blocks of one tile meet each other too: a block meets those after it
    others = others.withColumn("block", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> d <> 0 OR x < pmod(xxhash64(fp), blocks))")))
    return own.select(unit(block, F.col("lane")), F.lit(0).alias("side"), "fp").union(others.select(unit(F.col("block"), lane), F.lit(1), "fp"))


def merge(least: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j; ``least`` has the smallest index of each one's class and stays so."""
    while True:
        a, b = least[i], least[j]
        new = a != b
        if not new.any():
            return
        i, j, a, b = i[new], j[new], a[new], b[new]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least[:] = least[least]


def unit_links(own: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that is within the radius of others, directly or over others of the unit: it, and
    one of them."""
    everything = np.concatenate([own, others])
    least = np.arange(len(everything))
    high = max(1, CELLS // max(1, len(everything)))
    for at in range(0, len(own), high):
        i, j = np.nonzero(np.bitwise_count(own[at : at + high, None] ^ everything[None, at:]) <= radius)
        merge(least, i + at, j + at)
    joined = np.flatnonzero(least != np.arange(len(least)))
    return everything[joined], everything[least[joined]]


def _links(units: DataFrame, radius: int) -> DataFrame:
    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        side, fp = rows.column("side").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        a, b = unit_links(fp[side == 0], fp[side == 1], radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if held and key[x] != now:
                    yield linked(held)
                    held = []
                now = key[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield linked(held)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, fingerprint (16 hexadecimal digits), component_id (the smallest id that
    links reach, its own included)."""
    sketched = materialise(fingerprints(docs, id_col, text_col), "simhash")
    nodes = materialise(sketched.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    links = materialise(_links(_units(nodes, radius), radius), "simhash-links")
    roots = materialise(components(links), "simhash-roots")
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return sketched.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
