"""Exact quantiles of columns of any size, by group, with a bound on what is ever gathered."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the sketches: ranks are off by n / ACCURACY at most.
ACCURACY = 10_000
#: Values of one column, group and share that are gathered at most.
MOST = 10_000
#: Brackets of columns with no more values than FEW and than the accuracy; equal parts of a bracket when narrowed.
FEW, NEAR, PARTS = 500, 0.02, 256
#: Columns in one pass.
CHUNK = 32


@dataclass
class Bracket:
    """Values that enclose a wanted rank, and how many may lie strictly between them."""

    n: int
    share: float
    low: float
    high: float
    bound: float

    @property
    def ranks(self) -> tuple[int, int]:
        return floor(self.share * (self.n - 1)), ceil(self.share * (self.n - 1))

    def narrowed(self, below: int, on_low: int, upto: int, parts: list[float] | None, accuracy: int) -> None:
        """To the parts of the values inside (their quantiles) that hold the ranks."""
        first, inside = below + on_low, upto - below - on_low
        if not parts:
            self.bound = 0
            return
        slack = 2 / accuracy + 1e-9
        a, b = self.ranks
        i = min(PARTS, floor(((a - first) / inside - slack) * PARTS))
        j = max(0, ceil(((b + 1 - first) / inside + slack) * PARTS))
        self.low, self.high = parts[i] if i >= 0 else self.low, parts[j] if j <= PARTS else self.high
        self.bound = inside * ((min(j, PARTS) - max(i, 0)) / PARTS + 2 / accuracy) + 2


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], accuracy: int = ACCURACY, most: int = MOST) -> dict[str, list[float | None]]:
    """For each column the values that ``percentile`` gives (linear between neighbours, nulls left out)."""
    found = grouped_quantiles(df, None, columns, shares, accuracy, most)
    return found.get(0, {c: [None] * len(shares) for c in columns})


def grouped_quantiles(df: DataFrame, by: str | None, columns: list[str], shares: tuple[float, ...], accuracy: int = ACCURACY, most: int = MOST) -> dict:
    """The same for each group of ``by`` (groups are few, as splits are), all groups in one job for each step.

    A sketch of each column brackets each wanted rank.  While more than ``most`` values may lie inside a
    bracket, what is inside is sketched in turn: it is cut into PARTS parts, and the parts that hold the rank
    are the next bracket.  Then what lies inside is gathered, ``most`` values at most, and the rank is found
    among them.  Ties do not count: rows strictly inside are few, whatever the values.  The columns are kept
    while they are read several times."""
    key = F.lit(0) if by is None else F.col(f"`{by}`")
    rows = df.select(key.alias("g"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns))).persist()
    out: dict = {}
    try:
        for at in range(0, len(columns), CHUNK):
            taken = range(at, min(at + CHUNK, len(columns)))
            brackets, groups = _sketched(rows, taken, shares, accuracy)
            for g in groups:
                out.setdefault(g, {}).update({columns[i]: [None] * len(shares) for i in taken})
            while wide := {k: b for k, b in brackets.items() if b.bound > most}:
                _narrow(rows, wide, accuracy)
            for (g, i, j), value in _gathered(rows, brackets, most).items():
                out[g][columns[i]][j] = value
    finally:
        rows.unpersist()
    return out


def _sketched(rows: DataFrame, taken: range, shares: tuple[float, ...], accuracy: int) -> tuple[dict, list]:
    widths = (4 / accuracy, NEAR, 1.0)
    around = F.array(*(F.lit(min(1.0, max(0.0, s + d))) for s in shares for w in widths for d in (-w, w)))
    made = (F.struct(F.count(f"x{i}").alias("n"), F.percentile_approx(f"x{i}", around, accuracy).alias("ends")).alias(f"c{i}") for i in taken)
    brackets, groups = {}, []
    for r in rows.groupBy("g").agg(*made).collect():
        groups.append(r.g)
        for i in taken:
            n, ends = r[f"c{i}"]
            width = 2 if n <= FEW else 1 if n <= accuracy else 0
            for j, share in enumerate(shares) if n else ():
                at = 2 * (len(widths) * j + width)
                bound = min(n, n * (2 * widths[width] + 2 / accuracy) + 2)
                brackets[r.g, i, j] = Bracket(n, share, ends[at], ends[at + 1], bound)
    return brackets, groups


def _beside(rows: DataFrame, brackets: dict) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """Rows with the brackets of their group; the brackets as a table (one row for each group); their places."""
    slots = sorted({k[1:] for k in brackets})
    kind = rows.schema["g"].dataType.simpleString()
    table = []
    for g in dict.fromkeys(k[0] for k in brackets):
        held = [brackets.get((g, *s)) for s in slots]
        table.append((g, *(v for b in held for v in ((b.low, b.high, *b.ranks) if b else (None,) * 4))))
    schema = f"h {kind}, " + ", ".join(f"lo{k} double, hi{k} double, a{k} bigint, b{k} bigint" for k in range(len(slots)))
    small = F.broadcast(rows.sparkSession.createDataFrame(table, schema))
    return rows.join(small, F.col("g").eqNullSafe(F.col("h"))), small, slots


def _counted(k: int, i: int) -> tuple[list[Column], Column]:
    x, lo, hi = F.col(f"x{i}"), F.col(f"lo{k}"), F.col(f"hi{k}")
    return [F.count_if(x < lo).alias("below"), F.count_if(x == lo).alias("on_low"), F.count_if((x < hi) | (lo == hi) & (x == lo)).alias("upto")], F.when((x > lo) & (x < hi), x)


def _narrow(rows: DataFrame, brackets: dict, accuracy: int) -> None:
    joined, _, slots = _beside(rows, brackets)
    grid = F.array(*(F.lit(p / PARTS) for p in range(PARTS + 1)))
    parts = []
    for k, (i, _) in enumerate(slots):
        counts, inside = _counted(k, i)
        parts.append(F.struct(*counts, F.percentile_approx(inside, grid, accuracy).alias("parts")).alias(f"p{k}"))
    for r in joined.groupBy("g").agg(*parts).collect():
        for k, s in enumerate(slots):
            if (r.g, *s) in brackets:
                brackets[r.g, *s].narrowed(*r[f"p{k}"], accuracy)


def _gathered(rows: DataFrame, brackets: dict, most: int) -> dict:
    if not brackets:
        return {}
    joined, small, slots = _beside(rows, brackets)
    parts, picked = [], []
    for k, (i, _) in enumerate(slots):
        counts, inside = _counted(k, i)
        parts.append(F.struct(*counts, F.count_if(F.col(f"x{i}") == F.col(f"hi{k}")).alias("on_high"), F.sort_array(F.collect_list(inside)).alias("inside")).alias(f"p{k}"))
        p = F.col(f"p{k}")

        def held(rank: Column, p=p, k=k) -> Column:
            place = rank - p["below"] - p["on_low"]
            before, after = rank < p["below"], place >= F.size(p["inside"]) + p["on_high"]
            return F.when(before, None).when(place < 0, F.col(f"lo{k}")).when(place < F.size(p["inside"]), F.get(p["inside"], place.cast("int"))).when(~after, F.col(f"hi{k}"))

        picked.append(F.struct(held(F.col(f"a{k}")).alias("a"), held(F.col(f"b{k}")).alias("b"), F.size(p["inside"]).alias("size")).alias(f"q{k}"))
    found = {}
    for r in joined.groupBy("g").agg(*parts).join(small, F.col("g").eqNullSafe(F.col("h"))).select("g", *picked).collect():
        for k, s in enumerate(slots):
            bracket = brackets.get((r.g, *s))
            if bracket is None:
                continue
            a, b, size = r[f"q{k}"]
            if size > most or a is None or b is None:
                raise RuntimeError("the rows changed between two passes")
            share = bracket.share * (bracket.n - 1)
            low = floor(share)
            found[r.g, *s] = a if a == b else (low + 1 - share) * a + (share - low) * b
    return found
