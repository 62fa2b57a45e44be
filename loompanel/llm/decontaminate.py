"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are folded first: lower case, runs of other characters than letters and
digits to one space.  An item of L characters may occur with up to k = min(``edits`` * L, (L - q) / q)
edits; then some diagonal band of the text holds at least L - q + 1 - k q of the item's q-grams.

Each task rolls the q-gram hashes of a text in numpy, looks them up in the benchmark's table, counts
hits by item and overlapping diagonal band (width k + 1, each counted with its right neighbour), keeps
the bands that reach the bound, counts grams of three letters in them by the same lemma (a beginning
that many items share does not get past this), and verifies what is left by banded alignments, many side
by side.  Texts are read row by row, without a shuffle; items shorter than q are looked for as whole
words, by hash.

The benchmark table is gathered in blocks of at most ``block_bytes`` of text (its size is computed
first); a larger benchmark takes one pass over the texts for each block.  A single item is never cut.

Nulls: null texts and items hold nothing and match nothing; null ids are carried through.  Repeated
rows of either table each give their matches.  Other input columns are not read.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loompanel.llm.common import materialise, split_by_ids, text_of, worker_tables

Q = 8
EDITS = 0.1
BITS = 22
#: Letters of the q-grams of the finer count; hits expanded and cells aligned at a time.
FINE = 3
ENTRIES, CELLS = 1 << 22, 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _fold_table() -> np.ndarray:
    """The folded code point of every code point; 32 for what is neither letter nor digit."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD: list[np.ndarray] = []


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and where each stood in the text."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    codes = _FOLD[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run
    at = np.flatnonzero(keep)
    if len(at) and space[at[0]]:
        at = at[1:]
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return codes[at], at


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Rolling hashes of all q-grams (q a power of two), by doubling."""
    h = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    n, base = 1, _BASE
    while n < q:
        h = h[:-n] * np.uint64(base) + h[n:] if len(h) > n else h[:0]
        n, base = 2 * n, base * base % 2**64
    return h


def banded_distances(items: list[np.ndarray], windows: list[np.ndarray], budgets: np.ndarray, widths: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For each item the fewest edits (at most its budget) that turn it into a stretch of its window that
    starts within ``width`` of the front: (edits, start, end), or None.  All are aligned side by side.

    Cell j of row i stands for window place i + j - budget; the row is an alignment of item[:i].  Each
    cell keeps where its stretch began.
    """
    found: list[tuple[int, int, int] | None] = [None] * len(items)
    length = np.array([len(i) for i in items])
    reach = np.array([len(w) for w in windows])
    span, most = int((widths + 2 * budgets).max()) + 1, int(length.max())
    big = most + int(reach.max()) + 1
    letters = np.zeros((len(items), most), dtype=np.uint32)
    # letters beyond the window match nothing
    padded = np.full((len(items), most + span), np.iinfo(np.uint32).max, dtype=np.uint32)
    for c, (item, window, k) in enumerate(zip(items, windows, budgets.tolist())):
        letters[c, : len(item)] = item
        held = window[: most + span - k]
        padded[c, k : k + len(held)] = held
    place = np.arange(span)[None, :] - budgets[:, None]
    cost = np.where((place >= 0) & (place <= np.minimum(widths, reach)[:, None]), 0, big)
    start = place.copy()
    step = np.arange(span)
    alive = np.arange(len(items))
    gap, gap_start = np.full(cost.shape, big), np.zeros(cost.shape, dtype=np.int64)
    for i in range(most):
        diagonal = cost + (padded[:, i : i + span] != letters[:, i : i + 1])
        gap[:, :-1] = cost[:, 1:] + 1  # the item's letter is left out
        gap_start[:, :-1] = start[:, 1:]
        best = np.minimum(diagonal, gap)
        # letters of the window put in: cell j from cell j - d costs d
        source = np.minimum.accumulate((best - step) * span + step, axis=1) % span  # ties: the nearer front cell
        cost = np.take_along_axis(best, source, 1) + step - source
        start = np.take_along_axis(np.where(diagonal <= gap, start, gap_start), source, 1)
        for x in np.flatnonzero(length[alive] == i + 1).tolist():
            c = alive[x]
            end = i + 1 + place[x]
            last = np.where((end >= 0) & (end <= reach[c]), cost[x], big)
            j = int(np.argmin(last))
            if last[j] <= budgets[c]:
                found[c] = int(last[j]), int(start[x, j]), int(end[j])
        if not i % 8:
            on = (cost.min(axis=1) <= budgets[alive]) & (length[alive] > i + 1)
            if not on.any():
                break
            if on.mean() < 0.75:
                alive = alive[on]
                padded, letters, place, cost, start, gap, gap_start = (t[on] for t in (padded, letters, place, cost, start, gap, gap_start))
    return found


class Items:
    """The compiled table of one benchmark block."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, edits: float = EDITS) -> None:
        self.q = q
        folded = [(i, fold(t)[0]) for i, t in items if t]
        folded = [(i, c) for i, c in folded if len(c)]
        self.ids = [i for i, _ in folded]
        self.codes = [c for _, c in folded]
        length = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.budget = np.maximum(0, np.minimum((edits * length).astype(np.int64), (length - q) // q))
        self.bound = np.maximum(1, length - q + 1 - self.budget * q)
        hashes = [grams(c, q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        offset = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.offset = owner[order].astype(np.int64), offset[order].astype(np.int64)
        self.keys, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.map = np.zeros(1 << BITS, dtype=bool)
        self.map[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.joint = np.repeat(np.arange(len(self.keys)), self.times) * max(1, len(self.ids)) + self.owner  # rises
        self.short: dict[int, tuple[np.ndarray, list[int]]] = {}
        for n in sorted({len(c) for c in self.codes if len(c) < q}):
            of = [i for i, c in enumerate(self.codes) if len(c) == n]
            self.short[n] = np.array([self.whole(self.codes[i], n)[0] for i in of], dtype=np.uint64), of

    @staticmethod
    def whole(codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all stretches of n letters."""
        h = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(_BASE) + codes[j : len(codes) - n + 1 + j]
        return h

    def short_places(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Where items of less than q letters stand, as whole words."""
        found = []
        edge = np.concatenate([[True], codes == 32, [True]])  # before each place, and after the last
        for n, (hashes, of) in self.short.items():
            if len(codes) < n:
                continue
            free = np.flatnonzero(edge[: len(codes) - n + 1] & edge[n + 1 :])
            h = self.whole(codes, n)[free]
            at = free[np.isin(h, hashes)]
            for p in at.tolist():
                found += [(i, p, p + n, 0) for i in of if (self.codes[i] == codes[p : p + n]).all()]
        return found

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, start, end, edits) in places of the text."""
        codes, where = fold(text)
        found = self.short_places(codes) if self.short else []
        h = grams(codes, self.q)
        hit = np.flatnonzero(self.map[(h >> np.uint64(64 - BITS)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        if len(hit):
            k = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
            same = self.keys[k] == h[hit]
            hit, k = hit[same], k[same]
        if len(hit):
            whole = self.times[k].sum() <= ENTRIES
            bands = self.bands(hit, self.first[k], self.times[k]) if whole else self.candidates(hit, k, 0, len(self.ids))
            found += self.verified(codes, bands)
        apart: dict[int, tuple[list[int], list[int]]] = {}
        kept = []
        for i, a, b, e in sorted(set(found), key=lambda m: (m[0], m[3], m[1], m[2])):  # of overlapping matches of an item, the nearest
            starts, ends = apart.setdefault(i, ([], []))
            n = bisect_right(starts, a)
            if b > a and (n == 0 or ends[n - 1] <= a) and (n == len(starts) or starts[n] >= b):
                starts.insert(n, a)
                ends.insert(n, b)
                kept.append((i, a, b, e))
        return [(self.ids[i], int(where[a]), int(where[b - 1]) + 1, e) for i, a, b, e in sorted(kept)]

    def candidates(self, hit: np.ndarray, k: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
        """(item, front of a diagonal band) for the bands of the items low to high - 1 that hold enough of an
        item's q-grams.  At most about ENTRIES hits are expanded at a time: by halves of the items, then by
        overlapping stretches of the text."""
        n_ids = len(self.ids)
        begin = np.searchsorted(self.joint, k * n_ids + low)
        n = np.searchsorted(self.joint, k * n_ids + high) - begin
        total = int(n.sum())
        if total > ENTRIES and high - low > 1:
            middle = (low + high) // 2
            return self.candidates(hit, k, low, middle) + self.candidates(hit, k, middle, high)
        own = n > 0
        hit, begin, n = hit[own], begin[own], n[own]
        if total <= ENTRIES:
            return self.bands(hit, begin, n) if total else []
        length = len(self.codes[low])
        around = length + 4 * int(self.budget[low]) + 8
        step = max(4 * around, int(ENTRIES // max(1, n.max())))
        cuts = range(int(hit[0]), int(hit[-1]) + 1, step)
        parts = [slice(*np.searchsorted(hit, [x - around, x + step + around])) for x in cuts]
        return [c for p in parts if p.stop > p.start for c in self.bands(hit[p], begin[p], n[p])]

    def bands(self, hit: np.ndarray, begin: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        stop = np.cumsum(n)
        entry = np.arange(stop[-1]) + np.repeat(begin - (stop - n), n)
        owner = self.owner[entry]
        diagonal = np.repeat(hit, n) - self.offset[entry]
        width = self.budget[owner] + 1
        band = diagonal // width
        low = int(band.min())
        cells = int(band.max()) - low + 2
        cell = owner * cells + (band - low)
        order = np.argsort(cell, kind="stable")
        keys, first, counts = np.unique(cell[order], return_index=True, return_counts=True)
        offset = self.offset[entry[order]]
        right = np.zeros(len(keys), dtype=np.int64)
        follows = np.flatnonzero(np.diff(keys) == 1)
        right[follows] = counts[follows + 1]
        bound = self.bound[keys // cells]
        found = []
        # a pair of bands begins at each band that has hits (the band before it adds none)
        for x in np.flatnonzero(counts + right >= bound).tolist():
            i, b = divmod(int(keys[x]), cells)
            # an item's q-gram counts once, however often a repetitive text has it in the band
            if right[x] == 0 or len(np.unique(offset[first[x] : first[x] + counts[x] + right[x]])) >= bound[x]:
                found.append((i, (b + low) * (int(self.budget[i]) + 1)))
        return found

    def verified(self, codes: np.ndarray, bands: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the candidates that hold up: found unchanged, or aligned side by side."""
        found, close = [], []
        fine = self.fine(codes)
        spots: dict[int, list[int]] = {}
        for i, front in bands:
            spots.setdefault(i, []).append(front)
        for i, fronts in spots.items():
            item, budget = self.codes[i], int(self.budget[i])
            at = np.array(fronts)
            first = np.maximum(0, at - budget)  # where the stretch may begin
            last = at + 3 * budget + 1
            for x in self.likely(item, fine, budget, first, last).tolist():
                a = int(first[x])
                window = codes[a : int(last[x]) + 1 + len(item) + budget]
                exact = self.exact(item, window)
                if exact >= 0:
                    found.append((i, a + exact, a + exact + len(item), 0))
                elif budget:
                    close.append((i, a, int(last[x]) - a, item, window, budget))
        close.sort(key=lambda c: len(c[3]))
        at = 0
        while at < len(close):  # as many at a time as fit in CELLS cells
            n = max(1, CELLS // max(1, len(close[min(len(close), at + 512) - 1][3]) + 5 * close[at][5] + 2))
            part = close[at : at + min(n, 512)]
            at += len(part)
            aligned = banded_distances([c[3] for c in part], [c[4] for c in part], np.array([c[5] for c in part]), np.array([c[2] for c in part]))
            found += [(c[0], c[1] + m[1], c[1] + m[2], m[0]) for c, m in zip(part, aligned) if m]
        return found

    def likely(self, item: np.ndarray, text: np.ndarray, budget: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which of the stretches (they begin at first to last; text: its hashes) can hold the item, by the same lemma for shorter
        q-grams: of all but FINE * budget the item's places have to be met within the band.  This puts away
        texts that share a common beginning with many items and no more."""
        length = len(item)
        bound = length - FINE + 1 - FINE * budget
        good = last >= first
        if bound <= 0 or not budget or not len(text):
            return np.flatnonzero(good)
        whole = self.fine(item)
        reach = int((last - first).max()) + budget + 1
        met = np.zeros(len(first), dtype=bool)
        rows = max(1, CELLS // (len(whole) * (reach + budget)))
        for x in range(0, len(first), rows):
            a = first[x : x + rows]
            place = a[:, None] - budget + np.arange(len(whole) + reach + budget)[None, :]
            here = text[np.clip(place, 0, len(text) - 1)]
            views = np.lib.stride_tricks.sliding_window_view(here, reach + budget, axis=1)[:, : len(whole)]
            met[x : x + rows] = (views == whole[None, :, None]).any(axis=2).sum(axis=1) >= bound
        return np.flatnonzero(good & met)

    @classmethod
    def fine(cls, codes: np.ndarray) -> np.ndarray:
        return (cls.whole(codes, FINE) >> np.uint64(48)).astype(np.uint16)

    @staticmethod
    def exact(item: np.ndarray, window: np.ndarray) -> int:
        """The first place where the item stands unchanged, or -1."""
        if len(window) < len(item):
            return -1
        at = window.tobytes().find(item.tobytes())
        while at > 0 and at % 4:
            at = window.tobytes().find(item.tobytes(), at + 1)
        return at // 4 if at >= 0 else -1


class Shared:
    """A broadcast with a name of its own."""

    def __init__(self, df: DataFrame, value: object) -> None:
        self.id, self.held = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.held.value


def benchmark_blocks(benchmark: DataFrame, block_bytes: int, item_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """How many blocks the items make, and the blocks by a hash of the item; each is gathered on the driver for
    broadcast when its turn comes."""
    items = benchmark.select(F.col(item_col).alias("i"), text_of(text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = max(1, ceil(size / block_bytes))
    parts = (items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n))
    return n, ([(r.i, r.t) for r in part.collect()] for part in parts)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    edits: float = EDITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row for each place where an item occurs: id, item id, start and end (in characters of the
    text), edits.  Of several blocks each is a job of its own, whose rows are written before the next block is
    sent: a worker has one block's tables at a time."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__lp_t"))
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, start int, end int, edits int"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    n_blocks, blocks = benchmark_blocks(benchmark, block_bytes, item_col, text_col)
    parts = []
    for block in blocks:
        shared = Shared(docs, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = worker_tables("items", shared.id, edits, make=lambda: Items(shared.value, Q, edits))
            for batch in batches:
                found = [(n, *m) for n, t in enumerate(batch.column(1)) for m in items.find(t.as_py())]
                columns = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_type), *(pa.array(columns[i], pa.int32()) for i in (2, 3, 4))],
                    [id_col, item_col, "start", "end", "edits"],
                )

        part = rows.mapInArrow(run, schema)
        if n_blocks > 1:
            part = materialise(part, "contamination")
            shared.held.unpersist()
        parts.append(part)
    return reduce(DataFrame.unionAll, parts)


def _contaminated_texts(docs: DataFrame, shared: Shared, edits: float, text_col: str) -> DataFrame:
    """The hashes of texts in which an item of the block occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = worker_tables("items", shared.id, edits, make=lambda: Items(shared.value, Q, edits))
        for batch in batches:
            hit = pa.array([bool(items.find(t.as_py())) for t in batch.column(1)], pa.bool_())
            yield batch.select([0]).filter(hit)

    return docs.select(F.sha2(text_of(text_col), 256).alias("h"), text_of(text_col).alias("t")).mapInArrow(run, "h string").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the rows in whose text an item occurs.  Same columns; no shuffle for one block.

    Of several blocks each is a job of its own that writes the hashes of the texts it is found in; then the rows
    with such a text go.  A worker has one block's tables at a time, however large the benchmark is."""
    place = docs.columns.index(text_col)
    n_blocks, blocks = benchmark_blocks(benchmark, block_bytes, "item_id", "text")
    if n_blocks > 1:
        found = []
        for block in blocks:
            shared = Shared(docs, block)
            found.append(materialise(_contaminated_texts(docs, shared, edits, text_col), "contaminated"))
            shared.held.unpersist()
        texts = reduce(DataFrame.unionAll, found).distinct()
        maybe, sure = split_by_ids(docs.withColumn("__lp_h", F.sha2(text_of(text_col), 256)), texts, "__lp_h")
        return sure.union(maybe.join(texts, maybe["__lp_h"] == texts["h"], "left_anti")).select(*docs.columns)
    shared = Shared(docs, next(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = worker_tables("items", shared.id, edits, make=lambda: Items(shared.value, Q, edits))
        for batch in batches:
            yield batch.filter(pa.array([not items.find(t.as_py() or "") for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
