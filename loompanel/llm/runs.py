"""Periodic runs of words, found by a Kruskal pass over suffix classes in order of falling LCP.

A run is a stretch of consecutive words whose smallest period is q, of at least ``least`` words and three
periods, that no neighbouring word extends with that period.

*Suffix classes.*  The suffixes of a text are ordered by prefix doubling over word numbers; the ranks of all
doublings give the longest common prefix (LCP) of neighbours.  Neighbours are united in order of falling
LCP.  Each class keeps its positions in order, and the smaller one's are put into the larger one's; two
positions that become adjacent at distance d, when an LCP of l is united, share exactly l words, so d <= l
means that the l + d words from the first on have period d.  It is the smallest period: with a smaller one,
another position of the class would lie between the two.  And no run is missed: its first word and the word
one period later share exactly length - q words, and no position of their class lies between them.  What the
word before extends is the same run found from a later word and is passed over.

*Cut.*  A run of at least max(least, 3 q) words is seeded by an LCP of two thirds of ``least`` at least, so
smaller LCPs are not united.  A text in which no stretch of so many words occurs twice (told by sorting
hashes of all such stretches; equal stretches have equal hashes) has no run, which ends the work for most.

Each text is worked on by itself: no shuffle, memory in proportion to the longest text.

Nulls count as empty texts, repeated rows each get a row, null ids are carried through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import text_of
from loompanel.llm.minhash import mix

#: Words of a run at least, and its periods.
LEAST, PERIODS = 24, 3
#: Texts in one piece of an Arrow batch.
ROWS = 256
SPACE = "[ \\t-\\r]+"
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def number(words: list) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    return np.fromiter(map(_Numbers().__getitem__, words), dtype=np.int64, count=len(words))


def repeats(w: np.ndarray, k: int) -> bool:
    """Whether a stretch of k words may occur twice; never false if one does."""
    if len(w) <= k:
        return False
    h, width = mix(w.astype(np.uint64) + np.uint64(1)), 1
    while width < k:
        step = min(width, k - width)
        h = mix(h[: len(h) - step] * np.uint64(31) + h[step:])
        width += step
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([[True], values[1:] != values[:-1]])


def suffix_ranks(w: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... words, and the positions whose first k words (k a
    power of two) occur elsewhere too, in the order of their suffixes.  Past the end stands a word smaller
    than all others.  From k words on, only positions that are not told apart yet are sorted again."""
    n = len(w)
    rank, width, ranks = w, 1, [w.astype(np.int32)]

    def pairs(at: np.ndarray) -> np.ndarray:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        return rank[at] * (n + 1) + after[at]

    while width < k:
        _, rank = np.unique(pairs(np.arange(n)), return_inverse=True)
        width *= 2
        ranks.append(rank.astype(np.int32))
    times = np.bincount(rank)
    several = tied = np.flatnonzero(times[rank] > 1)
    rank = (np.cumsum(times) - times)[rank]  # the number of positions before, which can be refined in place
    while len(tied) and width < n:
        pair = pairs(tied)
        order = np.argsort(pair, kind="stable")
        tied, pair, at = tied[order], pair[order], np.arange(len(order))
        head, part = _starts(rank[tied]), _starts(pair)
        rank = rank.copy()
        rank[tied] += np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        width *= 2
        ranks.append(rank.astype(np.int32))
        tied = tied[~(part & np.append(part[1:], True))]
    return ranks, several[np.argsort(rank[several])]


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and at b share, for each two different positions."""
    n = len(ranks[0])
    total = np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + total, b + total
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ranks[level][x[inside]] == ranks[level][y[inside]]
        total += same.astype(np.int64) << level
    return total


def find_runs(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the numbered words, in order."""
    n = len(w)
    shortest = max(1, -(-least * (PERIODS - 1) // PERIODS))
    if n < least or not repeats(w, shortest):
        return []
    ranks, order = suffix_ranks(w, 1 << (shortest.bit_length() - 1))
    lcp = common_prefixes(ranks, order[:-1], order[1:]) if len(order) > 1 else np.zeros(0, np.int64)
    united = np.flatnonzero(lcp >= shortest)
    united = united[np.argsort(-lcp[united], kind="stable")]
    parent = list(range(len(order)))
    places: list[list[int] | None] = [[p] for p in order.tolist()]
    words, found = w.tolist(), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def seed(i: int, j: int, shared: int) -> None:
        d = j - i
        if (PERIODS - 1) * d <= shared and d + shared >= least and (i == 0 or words[i - 1] != words[j - 1]):
            found.append((i, d + shared, d))

    for at, shared in zip(united.tolist(), lcp[united].tolist()):
        a, b = root(at), root(at + 1)
        large, small = places[a], places[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b], places[b] = a, None
        cuts = [bisect_left(large, p) for p in small]
        for x, (p, k) in enumerate(zip(small, cuts)):
            # neighbours in the united class that come from the other one: those two share exactly ``shared`` words
            if k and (x == 0 or cuts[x - 1] < k):
                seed(large[k - 1], p, shared)
            if k < len(large) and (x + 1 == len(small) or cuts[x + 1] > k):
                seed(p, large[k], shared)
        for p, k in zip(reversed(small), reversed(cuts)):
            large.insert(k, p)
    return sorted(found)


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each input row: id, runs (start, length, period; by start, then period), collapsed (the words
    that stay, joined by one space)."""
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                runs, kept = [], []
                for text in part.column(1):
                    words = text.as_buffer().to_pybytes().split()
                    found = find_runs(number(words), least) if len(words) >= least else []
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    kept.append(b" ".join(collapse(words, found)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, run_type), pa.array(kept, pa.binary())], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, runs {RUN}, collapsed binary").select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equals.  Null without runs."""
    return F.reduce(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where every tenth text by the checksum h of its id ends in a repetition: each word from number
    a = g % n on becomes word a + (i - a) % p, with g = h div 10 and p = 1 + (n - a) div (3 + g % 8).  Texts
    that change are their words joined by one space; a null id changes nothing."""
    words = F.filter(F.split(text_of(text_col), SPACE), lambda x: x != "")
    h = F.crc32(F.col(id_col).cast("string"))
    repeated = F.transform("__lp_w", lambda _, i: F.when(i < F.col("__lp_a"), F.get("__lp_w", i)).otherwise(F.get("__lp_w", (F.col("__lp_a") + (i - F.col("__lp_a")) % F.col("__lp_p")).cast("int"))))
    out = docs.withColumn("__lp_h", h).withColumn("__lp_w", F.when(F.col("__lp_h") % 10 == 0, words)).withColumn("__lp_n", F.size("__lp_w"))
    out = out.withColumn("__lp_g", F.floor(F.col("__lp_h") / 10)).withColumn("__lp_a", F.when(F.col("__lp_n") > 0, F.col("__lp_g") % F.col("__lp_n")))
    out = out.withColumn("__lp_p", 1 + F.floor((F.col("__lp_n") - F.col("__lp_a")) / (3 + F.col("__lp_g") % 8)))
    return out.withColumn(text_col, F.when(F.col("__lp_n") > 0, F.array_join(repeated, " ")).otherwise(F.col(text_col))).select(*docs.columns)
