"""Near-duplicates by ProbMinHash, banding and verification.

*Sketch.*  A document is the set of its lower-cased words' five-word shingles, each of weight 1 however
often it occurs.  Every shingle is a Poisson process whose rate is its weight; each arrival hits one of
the signature's components at random, and a component keeps the shingle that hit it first.  Two
signatures agree in a component with the probability Jaccard similarity of the weighted sets; with
equal weights that is the Jaccard similarity of the sets, which also decides on a link.  Arrivals stop as soon as
no component can still change (a shingle whose next arrival comes after the latest first hit is
done), so a document costs its shingles plus about m ln m arrivals.

*Banding.*  32 bands of 6 components: two documents of similarity 0.8 share a band with probability
1 - (1 - 0.8^6)^32 > 0.9999.  Equal word sequences count as one node before anything is paired.  In a
bucket each member is paired with the bucket's smallest id first.  Where members of a bucket of three
or more then lie in different classes, all that remains between these classes is compared: block by
block, inside Python, where no row is made for a pair and what comes out is one link for each class that
joins another.  So every two texts that share a band are linked if they are alike.  A bucket of n
members in many classes costs n^2 comparisons, spread over its blocks.

*Verification.*  Pairs whose signatures agree in fewer than 60 % of the components are passed over
(similarity 0.8 gives so few with probability under 1e-9, as sketch and link have the same weights);
for the others the Jaccard similarity of the two shingle sets is computed exactly, and 0.8 or more makes a
link.  Sets are made once, for texts that share a bucket.

*Classes* are the connected components of the links, found by alternating large-star and small-star
steps until the edges are stars; the class id is its smallest document id.

Hot groups: equal documents are combined before the shuffle; every other step groups to one small
row for a key and joins that back, where adaptive execution splits the hot side.

Fewer than five words make one shingle of all words; texts without words are equal to each other
only.  Nulls count as empty texts.  Rows with a null id share the class of equal texts and have no
other links (class null if all ids are null).  Rows of one id are one document: their classes join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loompanel.llm.common import materialise, split_by_ids, text_of, worker_tables

SHINGLE = 5
COMPONENTS = 192
BANDS = 32
ROWS = COMPONENTS // BANDS
#: Words kept by a worker with their hashes; the cache starts anew when full.
CACHE_WORDS = 200_000
AGREE = 0.6
#: Buckets are compared in blocks of so many shingles (and sets, on average).
BLOCK, BLOCK_ROWS = 1 << 20, 2048

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(r"\w+").findall


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h



def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    words = _words(text.lower())
    known = worker_tables("minhash", make=_Hashes)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles, in order; one of all words if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(31) + hashes[i : n - k + 1 + i] + np.uint64(k))
    return h


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (n_docs x m, 16 bits of the winning shingle) of weighted sets given as flat arrays."""
    first = np.full(n_docs * m, np.inf)
    winner = np.zeros(n_docs * m, dtype=np.uint16)
    open_until = np.full(n_docs, np.inf)
    time = np.zeros(len(doc))
    seed = element
    while len(doc):
        seed = mix(seed + _GOLDEN)
        draw = mix(seed ^ np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        alive = time < open_until[doc]
        doc, element, weight, time, seed, draw = (x[alive] for x in (doc, element, weight, time, seed, draw))
        cell = doc * m + (draw % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        winner[cell[won]] = (element[won] >> np.uint64(48)).astype(np.uint16)
        open_until = first.reshape(n_docs, m).max(axis=1)
    return winner.reshape(n_docs, m)


def sketches(texts: list[str], m: int = COMPONENTS) -> tuple[list[bytes], list[int], list[bytes | None]]:
    """For each text: a 128-bit hash of its words, its number of distinct shingles, its signature."""
    hashes = [word_hashes(t) for t in texts]
    sets = [np.unique(shingles(h)) for h in hashes]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    element = mix(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64))
    signature = prob_minhash(doc, element, np.ones(len(element)), len(texts), m)
    return [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], sizes.tolist(), [s.tobytes() if n else None for s, n in zip(signature, sizes)]


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words_hash, n_shingles, signature; row by row, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                h, n, s = sketches(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h, pa.binary()), pa.array(n, pa.int32()), pa.array(s, pa.binary())], ["id", "words_hash", "n_shingles", "signature"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, words_hash binary, n_shingles int, signature binary")


def shingle_sets(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, shingles (the sorted set of 64-bit hashes, as bytes), for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [np.unique(shingles(word_hashes(t))).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["id", "shingles"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, shingles binary")


def _alike(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough components."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= AGREE))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, set_a, set_b) with exact Jaccard similarity of shingle sets >= threshold."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (s, t))
                few, many = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if few >= threshold * many else 0
                keep.append(both > 0 and both >= threshold * (few + many - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v) is a centre v or has one centre, and not both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child")), F.struct(F.col("v").alias("x"), F.lit(0).alias("child")))).alias("e")).select("e.*")
    seen = ends.groupBy("x").agg(F.sum("child").alias("n"), F.min("child").alias("least"))
    return seen.agg(F.count(F.when((F.col("n") > 1) | (F.col("n") == 1) & (F.col("least") == 0), 1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b) but the roots themselves; root is the
    smallest node of its connected component.  Large-star and small-star steps in turn, each written to
    the shared folder, until the edges are stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = materialise(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many elements each set of ``rows`` shares with each set of ``columns`` (indexes into ``sets``)."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    n = np.diff(np.append(start, len(token)))
    owners = np.add.reduceat(mix(doc.astype(np.uint64) + np.uint64(1)), start)  # elements of the same sets count together
    start, n, owners = start[n > 1], n[n > 1], owners[n > 1]
    _, first, times = np.unique(owners, return_index=True, return_counts=True)
    total = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for at in range(0, len(first), 1024):
        c, k = first[at : at + 1024], times[at : at + 1024]
        column = np.repeat(np.arange(len(c)), n[c])
        cell = np.arange(len(column)) - np.repeat(np.cumsum(n[c]) - n[c], n[c]) + np.repeat(start[c], n[c])
        x = np.zeros((len(sets), len(c)), dtype=np.float32)
        x[doc[cell], column] = 1
        total += (x[rows] * k.astype(np.float32)) @ x[columns].T
    return total


def joined_classes(sets: list[np.ndarray], root: np.ndarray, rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    """For each class number (``root`` has each set's) the smallest one that it is linked with, over any
    number of links between sets of ``rows`` and of ``columns``."""
    size = np.array([len(s) for s in sets])
    both = overlaps(sets, rows, columns).astype(np.float64)
    like = (both > 0) & (both >= threshold * (size[rows][:, None] + size[columns][None, :] - both)) & (root[rows][:, None] != root[columns][None, :])
    i, j = np.nonzero(like)
    u, v = np.unique(np.stack([root[rows[i]], root[columns[j]]]), axis=1)
    least = np.arange(root.max() + 1)
    while True:
        now = least.copy()
        np.minimum.at(now, u, least[v])
        np.minimum.at(now, v, least[u])
        if (now == least).all():
            return least
        least = now


def _blocks(members: DataFrame) -> DataFrame:
    """(band, node, root, block, i, j) for the members (band, node, n_shingles, root) of the buckets that
    hold several classes: the block of the member, and each two blocks (i <= j) that it takes part in.

    A bucket is dealt to blocks of about BLOCK shingles.  A class of more than a block has blocks of its
    own, which are not compared with one another.
    """
    weight = F.greatest(F.col("n_shingles"), F.lit(BLOCK // BLOCK_ROWS)).cast("long")
    kinds = materialise(members.groupBy("band", "root").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")), "classes")
    kinds = kinds.withColumn("own", F.when(F.col("w") > BLOCK, F.ceil(F.col("w") / BLOCK)).otherwise(0))
    # the pair of a bucket of two is tried already
    bands = kinds.groupBy("band").agg(F.ceil(F.sum(F.when(F.col("own") == 0, F.col("w")).otherwise(0)) / BLOCK).alias("shared"), F.sum("own").alias("owned"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    bands = materialise(bands.where("k > 1 AND n > 2").select("band", "shared", "owned"), "mixed")
    before = Window.partitionBy("band").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    large = kinds.where("own > 0").select("band", "root", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("at"))
    dealt = members.join(bands, "band").join(materialise(large, "large"), ["band", "root"], "left")
    dealt = dealt.withColumn("block", F.coalesce(F.expr("shared + at + pmod(xxhash64(node), own)"), F.expr("pmod(xxhash64(root), shared)")))
    others = F.expr("filter(sequence(0L, cast(shared + owned as bigint) - 1), x -> own IS NULL OR x < shared + at OR x >= shared + at + own)")
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("band", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _block_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes, from the exact similarity of the members (band, root, block, i, j,
    shingles) of each two blocks.  One pair of blocks is held in memory at a time."""
    kind = dealt.schema["root"].dataType.simpleString()
    keys = ["band", "i", "j"]
    columns = ["band", "i", "j", "block", "root", "shingles"]

    def links(rows: pa.Table) -> pa.RecordBatch:
        types = rows.schema.field("root").type
        root = rows.column("root").to_numpy()
        names, number = np.unique(root, return_inverse=True)
        block, i, j = rows.column("block").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        one, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        least = np.arange(len(names))
        if len(names) > 1 and len(one) and len(other):
            sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in rows.column("shingles")]
            least = joined_classes(sets, number, one, other, threshold)
        a = np.flatnonzero(least < np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[a].tolist(), types), pa.array(names[least[a]].tolist(), types)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                this = tuple(key[:, x].tolist())
                if held and this != now:
                    yield links(pa.Table.from_batches(held))
                    held = []
                now = this
                held.append(batch.slice(x, y - x))
        if held:
            yield links(pa.Table.from_batches(held))

    return dealt.select(columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, class_id (the smallest id of its class), kept (it is that one)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sketched = materialise(sketch(docs, id_col, text_col), "sketch")
    nodes = materialise(sketched.groupBy("words_hash", "n_shingles", "signature").agg(F.min("id").alias("node")), "nodes")
    graph = nodes.where("node IS NOT NULL AND n_shingles > 0")
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)))
    banded = graph.select("node", "n_shingles", F.explode(keys).alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "rep")
    # written before the join: adaptive execution splits the hot buckets of plain shuffles only
    members = materialise(banded.join(materialise(shared, "buckets"), "band"), "members")

    maybe, _ = split_by_ids(rows, members.select("node"), "id")
    repeated = materialise(sketched.where("id IS NOT NULL").groupBy("id").agg(F.min("words_hash").alias("lo"), F.max("words_hash").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    sets = shingle_sets(maybe)
    sets = materialise(sets if repeated.isEmpty() else sets.distinct(), "sets")
    set_a, set_b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    sig_a, sig_b = (graph.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    pairs = members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    alike = materialise(_alike(pairs.join(sig_a, "a").join(sig_b, "b")).distinct(), "alike")
    links = materialise(_verified(alike.join(set_a, "a").join(set_b, "b"), threshold).union(_same_id(repeated.where("lo <> hi").select("id"), sketched, nodes)), "links")
    roots = materialise(components(links), "roots")

    placed = materialise(members.join(roots, "node", "left").select("band", "node", "n_shingles", F.coalesce("root", "node").alias("root")), "placed")
    dealt = _blocks(placed).join(sets.withColumnRenamed("id", "node"), "node")
    more = materialise(_block_links(dealt, threshold), "links")
    ends = materialise(components(more), "roots")  # of classes
    classes = nodes.where("node IS NOT NULL").join(roots, "node", "left").select("words_hash", F.coalesce("root", "node").alias("root"))
    classes = classes.join(ends.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("words_hash", F.coalesce("end", "root").alias("class_id"))
    return sketched.select("id", "words_hash").join(classes, "words_hash", "left").select(
        F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept")
    )


def _same_id(several: DataFrame, sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between all nodes in which one of these ids occurs."""
    held = sketched.join(several, "id").join(nodes.select("words_hash", "node"), "words_hash").select("id", "node").distinct()
    least = held.groupBy("id").agg(F.min("node").alias("b"))
    return held.join(least, "id").select(F.col("node").alias("a"), "b").where("a <> b")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class; rows with a null id stay.  Same columns.

    An id with several texts is one document: all its texts stay or go together, equal ones once.  Only
    rows that may have to go (their id is dropped or repeated) are shuffled.
    """
    found = materialise(near_duplicates(docs, threshold, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__lp_id"), "kept"), "kept")
    doubtful = found.groupBy("__lp_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("n > 1 OR NOT kept")
    maybe, sure = split_by_ids(docs, doubtful.select("__lp_id"), id_col)
    stay = found.where("kept").select("__lp_id").distinct()
    named = maybe.where(F.col(id_col).isNotNull())
    kept = named.join(stay, named[id_col] == stay["__lp_id"], "left_semi").withColumn("__lp_h", F.sha2(text_of(text_col), 256)).dropDuplicates([id_col, "__lp_h"]).drop("__lp_h")
    return sure.union(kept).union(maybe.where(F.col(id_col).isNull()))
