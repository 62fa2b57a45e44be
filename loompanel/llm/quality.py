"""Quality classifier from weak labels.

*Labellers.*  Nine heuristics look at a whole text and vote bad (0), good (1) or nothing (2).

*Label model.*  How often each combination of votes occurs is counted over all documents (at most 3^9
combinations, counted in the tasks, so the shuffle and the driver get a few thousand rows at most).
Expectation-maximisation estimates from these counts the share of good texts and, for each labeller,
how it votes on good and on bad texts; the posterior of a combination is its weak label.

*Scorer.*  A logistic regression on hashed word shapes learns the posteriors from a bounded sample of
documents (about ``train_docs`` distinct ones, drawn by a hash of id and text).  It scores every text whole, row by row, and
carries the labels over to texts on which the labellers are silent or divided.

Nulls count as empty texts; texts without words get score 0.  An empty table gives a model of even
odds; if nothing is drawn from a table with rows, fitting fails.  Repeated rows each get a row, and
their votes count each time; the scorer learns from them once.  The filter returns the input's columns as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import text_of, worker_tables

BAD, GOOD, NONE = 0, 1, 2
SYMBOLS = "#$%&*|<>{}[]^~=+\\@_"
LABELLERS = ("symbols", "capitals", "repeats", "variety", "doubled_marks", "bars", "short_words", "sentences", "word_length")
BINS = 1 << 13
CACHE_WORDS = 200_000


def votes(text: str) -> str:
    """One digit for each labeller."""
    words = text.split()
    n = len(words)
    if n == 0:
        return str(NONE) * len(LABELLERS)
    symbols = sum(map(text.count, SYMBOLS)) / len(text)
    capitals = sum(map(str.isupper, words)) / n
    repeats = sum(map(eq, words, words[1:])) / n
    variety = len(set(words)) / n
    marks = sum(map(text.count, ("!!", "??", "**", "$$", "%%", "##", "&&", "..."))) / n
    bars = words.count("|") / n
    short = sum(1 for w in words if len(w) <= 3) / n
    sentences = (text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? ") + 1) / n
    mean = (len(text) - n + 1) / n
    enough = n >= 20
    return "".join(
        str(v)
        for v in (
            BAD if symbols > 0.08 else GOOD if symbols < 0.02 else NONE,
            BAD if capitals > 0.5 and n >= 5 else GOOD if capitals < 0.1 else NONE,
            BAD if repeats > 0.3 and n >= 5 else GOOD if repeats < 0.05 else NONE,
            BAD if variety < 0.15 and enough and n < 2000 else GOOD if variety > 0.4 else NONE,
            BAD if marks > 0.3 and n >= 3 else GOOD if marks < 0.02 else NONE,
            BAD if bars > 0.2 else GOOD if bars < 0.01 else NONE,
            BAD if short < 0.05 and enough else GOOD if short > 0.15 or not enough else NONE,
            GOOD if sentences > 0.02 else NONE,
            BAD if mean > 14 and enough else GOOD if 3 < mean < 10 else NONE,
        )
    )


def count_votes(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How many texts got each combination of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            seen.update(votes(t.as_py()) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    counted = docs.select(text_of(text_col).alias("t")).mapInArrow(run, "votes string, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))
    return {r.votes: r.n for r in counted.collect()}


@dataclass
class LabelModel:
    """prior: share of good texts.  table[labeller, class, vote]: probability of a vote in a class."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        v = np.array([[int(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), len(LABELLERS))
        logs = np.log(self.table)[np.arange(len(LABELLERS)), :, v].sum(axis=1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(logs[:, BAD] - logs[:, GOOD], -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """For each labeller: how often its votes are right, by the model."""
        share = np.array([1 - self.prior, self.prior])
        right = self.table[:, BAD, BAD] * share[BAD] + self.table[:, GOOD, GOOD] * share[GOOD]
        cast = ((self.table[:, :, BAD] + self.table[:, :, GOOD]) * share).sum(axis=1)
        return dict(zip(LABELLERS, (right / np.maximum(cast, 1e-12)).tolist()))


def fit_label_model(counts: dict[str, int], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation from the majority of the votes; one bad vote outweighs good ones at the
    start, as a labeller votes bad on its own kind of defect only."""
    patterns = sorted(counts)
    if not patterns:
        return LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    n = np.array([counts[p] for p in patterns], dtype=np.float64)
    v = np.array([[int(c) for c in p] for p in patterns], dtype=np.int64)
    good = np.where((v == BAD).any(axis=1), 0.1, np.where((v == GOOD).any(axis=1), 0.9, 0.5))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        table = np.stack([[[weight[c][v[:, j] == k].sum() + 0.1 for k in range(3)] for c in range(2)] for j in range(v.shape[1])])
        table /= table.sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3)), table)
        good = model.posterior(patterns)
    return model


class Shapes(dict):
    """The bin of a word's shape: runs of capitals, small letters and digits become A, a and 0; other
    characters stand for themselves, once for each run."""

    def __missing__(self, word: str) -> int:
        shape: list[str] = []
        for c in word:
            k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
            if not shape or shape[-1] != k:
                shape.append(k)
        found = xxhash.xxh3_64_intdigest("".join(shape)) % BINS
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found



def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and values of a text's hashed features: shapes, pairs of shapes, repeated words, lengths;
    roots of relative frequencies, scaled to length one."""
    words = text.split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    shape = np.fromiter(map(worker_tables("quality", make=Shapes).__getitem__, words), dtype=np.int64, count=n)
    length = np.minimum(np.fromiter(map(len, words), dtype=np.int64, count=n), 15)
    same = np.fromiter(map(eq, words, words[1:]), dtype=bool, count=n - 1)
    parts = [shape, (shape[:-1] * 31 + shape[1:] * 17 + 7) % BINS, (length * 101 + 3) % BINS, np.where(same, 11, 13)]
    bins, counts = np.unique(np.concatenate(parts), return_counts=True)
    values = np.sqrt(counts / n)
    return bins.astype(np.int32), (values / np.sqrt((values**2).sum())).astype(np.float32)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        bins, values = features(text)
        if not len(bins):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + (self.weights[bins] * values).sum(), -60, 60))))


def draw_below(share: float) -> int:
    """The bound that a share (below 1) of all 63-bit hashes stays under."""
    return max(1, int(share * 2**63))


def fit_quality(docs: DataFrame, train_docs: int = 6_000, id_col: str = "doc_id", text_col: str = "text", steps: int = 300) -> QualityModel:
    counts = count_votes(docs, text_col)
    labels = fit_label_model(counts)
    total = sum(counts.values())
    # a text of an id is drawn once, however often it is repeated: about train_docs rows at any size
    drawn = docs.select(F.col(id_col).alias("__lp_id"), text_of(text_col).alias("t"))
    if total > train_docs:
        drawn = drawn.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), "__lp_id", "t"), 1) < draw_below(train_docs / total))
    drawn = drawn.distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            made = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in texts]), pa.array([b.tobytes() for b, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["votes", "bins", "values"])

    rows = drawn.select("t").mapInArrow(run, "votes string, bins binary, values binary").collect()
    if not rows and total:
        raise RuntimeError(f"none of {total} documents was drawn for training")
    rows = sorted((r for r in rows if len(r.bins)), key=lambda r: (bytes(r.bins), bytes(r["values"]), r.votes))  # one order, one result
    weights, bias = np.zeros(BINS), 0.0
    if not rows:
        return QualityModel(labels, weights, bias)
    target = labels.posterior([r.votes for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r.bins) // 4 for r in rows])
    bins = np.frombuffer(b"".join(bytes(r.bins) for r in rows), dtype=np.int32)
    values = np.frombuffer(b"".join(bytes(r["values"]) for r in rows), dtype=np.float32).astype(np.float64)
    balance = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3))
    balance /= balance.sum()
    mean, square = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for step in range(1, steps + 1):  # Adam
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights[bins] * values, len(rows)), -60, 60)))
        slope = (p - target) * balance
        gradient = np.append(np.bincount(bins, slope[row] * values, BINS) + 1e-5 * weights, slope.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        move = 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return QualityModel(labels, weights.astype(np.float32), bias)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, votes, weak_label (posterior of the votes), score, kept (score >= threshold)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights and a small table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                seen = [votes(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seen), pa.array(m.labels.posterior(seen)), pa.array([m.score(t) for t in texts], pa.float64())], [id_col, "votes", "weak_label", "score"])

    rows = docs.select(F.col(id_col), text_of(text_col).alias("__lp_t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, votes string, weak_label double, score double").withColumn("kept", F.col("score") >= threshold)


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``; same columns, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py() or "") >= threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
