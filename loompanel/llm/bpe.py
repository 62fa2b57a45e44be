"""Byte-level BPE by backtracking, exact and in linear time.

For every place of a pre-token, one Aho-Corasick run gives the longest vocabulary token that starts
there.  The encoder walks from the left, takes the longest token that is compatible with the token
before it, shortens it where it is not, and steps back from places that proved to be dead ends;
each place is entered once.  Two tokens are compatible if encoding their joined bytes gives just
these two; the answers are kept in a pair table.  Adjacent compatible tokens make the one sequence
that applying the merges by rank would make.

Decoding is a gather of bytes by an offset table: token i is ``blob[offset[i]:offset[i+1]]``.

Texts are encoded in Spark tasks, row by row and without a shuffle; a worker keeps the ids of the
pre-tokens it met in a cache of bounded size, and memory does not grow with the input.

Nulls count as empty texts (no ids); special-token strings in a text become their ids, as the
tokenizer file says.  Input columns other than those named are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import tokenizer_file, worker_tables

#: Fixed: how the byte-level scheme cuts text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens kept by a worker; the cache starts anew when full.
CACHE_WORDS = 200_000
#: Longer pre-tokens (in characters) are encoded each time.
CACHE_CHARS = 48
PAIRS = 300_000
GAP = "Ā"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The compiled tables of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(tokenizer_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: "".join(chr(letters[c]) for c in token)  # noqa: E731  bytes as Latin-1 text
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.text = [""] * size
        for token, i in vocab.items():
            if token not in special:
                self.text[i] = raw(token)
        by_text = {t: i for i, t in enumerate(self.text) if t}
        self.born = [-1] * size  # rank of the merge that makes the token; bytes are there from the start
        self.left, self.right = [-1] * size, [-1] * size
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = vocab[a], vocab[b]
            self.rank[x << 20 | y] = r
            made = vocab[a + b]
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = r, x, y
        self.length = [len(t) for t in self.text]
        self.shorter = [-1] * size  # the longest proper prefix that is a token
        self.longest = ahocorasick.Automaton()
        for t, i in by_text.items():
            if self.length[i] == 1 or self.born[i] >= 0:
                self.longest.add_word(t, i)
                self.shorter[i] = next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1)
        self.longest.make_automaton()
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pre = regex.compile(PRE_TOKEN).findall
        spelled = [t.encode("latin-1") for t in self.text]
        for token, i in special.items():
            spelled[i] = token.encode()
        self.blob = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.pairs: dict[int, bool] = {}
        self.words = Words(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge would cross from token a to token b.

        Undo the merges at the border from the latest on.  While the border lies between x and y,
        the pair would have merged if its rank comes before that of the merge last undone (of two
        merges of equal rank, the left one comes first).
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        born, rank = self.born, self.rank
        x, y, until = a, b, 1 << 30
        while True:
            if rank.get(x << 20 | y, 1 << 30) < until:
                ok = False
                break
            if born[x] < 0 and born[y] < 0:
                ok = True
                break
            if born[x] > born[y]:
                until, x = born[x], self.right[x]
            else:
                until, y = born[y] + 1, self.left[y]  # a border merge of the same rank stands further left
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if not word:
            return []
        raw = word.encode().decode("latin-1")
        end = len(raw)
        at: list[int] = [-1] * end
        length = self.length
        for last, token in self.longest.iter(raw):
            at[last + 1 - length[token]] = token  # longer ones come later
        ids: list[int] = []
        dead = bytearray(end + 1)
        place, token = 0, at[0]
        while True:
            then = place + length[token]
            if not dead[then] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                if then == end:
                    return ids
                place, token = then, at[then]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: step back
                dead[place] = 1
                token = ids.pop()
                place -= length[token]
                token = self.shorter[token]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.pre(text)))
        out = []
        for part in self.cut.split(text):
            out.append(self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(self.words.__getitem__, self.pre(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; broken UTF-8 gives replacement characters."""
        i = np.frombuffer(ids, dtype="<u4")
        start = self.offset[i]
        n = self.offset[i + 1] - start
        stop = np.cumsum(n)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - n), n)
        return self.blob[at].tobytes().decode("utf-8", "replace")


class Words(dict):
    """Packed ids by pre-token."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.bpe.encode_word(word)).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def compiled(path: str) -> Bpe:
    """The tables of a tokenizer file, once for each worker."""
    return worker_tables("bpe", path, make=lambda: Bpe(path))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bpe_encode(docs: DataFrame, path: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (packed little-endian unsigned 32-bit integers)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(path)
        for part in _slices(batches):
            ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def bpe_decode(encoded: DataFrame, path: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the texts of packed ids (null: empty)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(path)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x or b"") for x in part.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def bpe_round_trip(docs: DataFrame, path: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and the text decoded from these ids, in one pass of the workers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(path)
        for part in _slices(batches):
            ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded string")


def digests(trip: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return trip.select(id_col, "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
