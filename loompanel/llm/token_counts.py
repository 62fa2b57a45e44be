"""Token counts by a two-tier lookup on the map side.

A text falls into pre-tokens that no vocabulary piece crosses, so its token count is the sum of
theirs.  Tier one is a packed table of frequent pre-tokens and their lengths, which is broadcast:
at most ``table_words`` entries, so its size has a fixed bound.  Tier two is a cache in each worker;
what neither holds is encoded by the tokenizer itself.  No pre-token is shuffled.

Which pre-tokens are frequent is read off a bounded sample of documents (``sample_docs``).  The
sample decides nothing but speed: every text is counted whole, whatever the table holds.

Nulls count as empty texts; repeated rows each get a row; other input columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import materialise, text_of, tokenizer_file, worker_tables

#: Pre-tokens kept by a worker besides the table; the cache starts anew when full.
CACHE_WORDS = 400_000
CACHE_CHARS = 64


class Pieces:
    """A sentencepiece model: pre-tokens are runs between spaces, with the spaces before them; a line
    break stands alone.  Checked when loaded: no piece has a space after another character or holds
    a line break."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(path))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path}: its pieces cross the borders of pre-tokens")
        self.cut = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n").findall
        self.base = len(self.model.encode("\n"))

    def split(self, text: str) -> list[str]:
        return self.cut(" " + text) if text else []

    def length(self, word: str) -> int:
        """A line break before the word keeps the model from putting a space there."""
        return len(self.model.encode("\n" + word)) - self.base


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, by the pre-tokens of its own pattern."""

    def __init__(self, path: str) -> None:
        from loompanel.llm.bpe import Bpe

        self.bpe = Bpe(path)

    def split(self, text: str) -> list[str]:
        bpe = self.bpe
        if bpe.cut is None or not any(s in text for s in bpe.special):
            return bpe.pre(text)
        return [w for part in bpe.cut.split(text) for w in ([part] if part in bpe.special else bpe.pre(part))]

    def length(self, word: str) -> int:
        return 1 if word in self.bpe.special else len(self.bpe.encode_word(word))


def counter_of(path: str) -> Pieces | ByteLevel:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class Lengths(dict):
    """Tier two: lengths by pre-token, filled from the table first."""

    def __init__(self, length: Callable[[str], int], first: dict[str, int]) -> None:
        super().__init__(first)
        self.length, self.first = length, first

    def __missing__(self, word: str) -> int:
        n = self.length(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS + len(self.first):
                self.clear()
                self.update(self.first)
            self[word] = n
        return n


def pack(table: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The words' bytes, where each ends, and the lengths."""
    words = [w.encode() for w in table]
    return b"".join(words), np.cumsum([len(w) for w in words], dtype=np.uint32).tobytes(), np.array(list(table.values()), dtype=np.uint16).tobytes()


def unpack(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    blob, ends, lengths = packed
    stops = np.frombuffer(ends, dtype=np.uint32).tolist()
    return {blob[a:b].decode(): n for a, b, n in zip([0, *stops], stops, np.frombuffer(lengths, dtype=np.uint16).tolist())}


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", table_words: int = 32_768, sample_docs: int = 2_000) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample (``table_words`` at most), with their lengths."""
    n = docs.count()
    picked = docs.select(text_of(text_col).alias("t")).sample(min(1.0, sample_docs / max(n, 1)), seed=5)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = counter_of(path).split
        for batch in batches:
            seen = Counter(w for t in batch.column(0).to_pylist() for w in split(t))
            kept = [(w, k) for w, k in seen.items() if len(w) <= CACHE_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([k for _, k in kept], pa.int64())], ["w", "k"])

    counts = materialise(picked.mapInArrow(words, "w string, k bigint").groupBy("w").agg(F.sum("k").alias("k")), "words")
    # how many words occur how often tells from where on at most table_words are left: only these are gathered
    least, total = 1 << 62, 0
    for r in counts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).limit(table_words).collect():
        total += r.n
        if total > table_words:
            break
        least = r.k
    length = counter_of(path).length
    return {w: length(w) for w in sorted(r.w for r in counts.where(F.col("k") >= least).select("w").collect())}


def count_tokens(
    docs: DataFrame,
    path: str = "piece_bpe_32k.model",
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_words: int = 32_768,
    sample_docs: int = 2_000,
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(pack(frequent_words(docs, path, text_col, table_words, sample_docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            counter = counter_of(path)
            return counter.split, Lengths(counter.length, unpack(shared.value))

        split, lengths = worker_tables("tokens", path, hash(shared.value), make=make)
        get = lengths.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = [sum(map(get, split(t))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col), text.alias("__lp_t"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
