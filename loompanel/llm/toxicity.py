"""Toxicity by noisy-channel deobfuscation.

*Channel.*  A writer hides a word by look-alike characters (``1d10t``, Cyrillic or accented letters), by
pulling it apart (``i d i o t``, ``i.d-iot``, ``id iot``) or by repeating letters (``iidiooot``).  A token
becomes a lattice: each character may stand for itself or for the letters it can imitate, a run of equal
letters for one or two of them, a space between pieces and a run of separators for itself or nothing.
Viterbi decoding under a character trigram model finds the likeliest reading.  Strong signs replace the
token in the restored text; weak ones (one doubled letter, a look-alike at an end, separators between
longer parts) also occur in plain text: there the token's own words count besides the decoded one.
Tokens of digits alone are numbers.

*Language model.*  Trigrams of characters are counted over all documents into a table in the shared
folder, which grows with what the corpus holds.  Decoding takes from it the trigrams of a to z, all that
look-alikes are read as, and of the ``LETTERS`` most frequent letters, so what is broadcast has a fixed bound.
Any other letter costs more than one of these can in its place: it never beats the letter that it imitates
by being unknown.

*Gate.*  Readings of one token share a skeleton: look-alikes as letters, runs as one letter, separators
gone.  A token is decoded if the skeleton of a part of it is that of a marked word or begins with that of a
marked stem; no other token can be read as one, so nothing is lost.

*Score.*  In labelled texts (a bounded sample, ``train_docs``) skeletons and their beginnings are counted
by label.  Tokens whose skeletons mark toxic texts beyond chance (lower confidence bound of their precision
at ``MARK`` or more) are decoded, and the words and stems read are counted anew by the distinct pairs of
words around them, so that copies of a text count once; those still beyond chance weigh the log of their
odds.  A stem counts only if it marks toxic texts in ``KINDS`` different ways to go on or more, and also without the
most frequent of these: a plain word that begins like one insult is none.  A logistic regression on a text's largest weights, its length and the weight for its length gives
the score; both labels weigh the same in it.  Texts are scored whole, row by row.

Nulls count as empty texts (a low score, as for any text without marks).  Unlabelled rows and null labels
train nothing; a text of an id trains once for each of its labels.  Repeated rows each get a row; other
input columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, sqrt
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loompanel.llm.common import materialise, text_of

#: The letters that a character can imitate, and letters of other alphabets by their looks.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
ALIKE = dict(zip("авеіјкмнорстухѕԁӏԛԝαβεικνορτυχ", "abeijkmhopctyxsdlqwabeikvoptux"))
LETTERS = 64
OTHER, BORDER = 1, 0
STRONG = re.compile(r"[^\W\d_][0134578@$!|+€£]+[^\W\d_]|^[0134578@$]+[^\W\d_]{2}|[^\W\d_]{2}[0134578@$]+$|([^\W\d_])\1\1|^[^\W_](?:[.\-_*~/\\,]+[^\W_]){2,}$")
SEPARATORS = ".-_*~/\\,"
RUNS = re.compile(r"(.)\1*", re.DOTALL)
WORD = re.compile(r"[^\W_]+").findall
PART = re.compile(r"[^\W_]+|.", re.DOTALL).findall
EDGES = ".,;:!?\"'()[]{}<>#%&*=-–—…«»“”„"
INNER = EDGES.replace("!", "")
GAP = "\x1f"
STEM = range(3, 7)
KINDS = 3
LONGEST = 24
TOP = 3
MARK = 0.3
Z = 2.33
CACHE_WORDS = 300_000


class _Skeleton(dict):
    """The letter that a character counts as in a skeleton ("" for separators); i and l look alike."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[:1].lower() or c
        base = ALIKE.get(base, IMITATES.get(base, base))[:1]
        self[code] = found = "i" if base == "l" else base if base.isalpha() or base.isdigit() else ""
        return found


_SKELETON = _Skeleton()
_double = re.compile(r"(.)\1+", re.DOTALL)


def skeleton(token: str) -> str:
    return _double.sub(r"\1", token.translate(_SKELETON))


def skeletons(token: str, longest: int) -> set[str]:
    """The skeletons of a token's parts, of about ``longest`` letters at most: a part is what stands between
    two characters that are no letter or digit, with or without these."""
    if token.isalnum():
        return {skeleton(token)}
    parts = list(map(skeleton, PART(token)))
    found = set()
    for a, whole in enumerate(parts):
        if not whole:
            continue
        found.add(whole)
        for part in parts[a + 1 :]:
            if len(whole) > longest:
                break
            if part:
                whole = _double.sub(r"\1", whole + part)
                found.add(whole)
    return found


def keys_of(token: str) -> set[str]:
    """Skeletons and their beginnings ("abc*")."""
    found = skeletons(token, LONGEST)
    return found | {s[:n] + "*" for s in found for n in STEM if len(s) > n}


_FOLD: list[np.ndarray] = []


def _folded(text: str) -> np.ndarray:
    """Code points in lower case, with white space as BORDER and what is no letter as OTHER."""
    if not _FOLD:
        table = np.full(0x110000, OTHER, dtype=np.uint64)
        for c in range(0x110000):
            x = chr(c)
            if x.isspace():
                table[c] = BORDER
            elif x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each trigram of characters occurs in all texts: gram (three times 21 bits), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                c = _folded("\n\n" + "\n\n".join(batch.column(0).slice(at, 512).to_pylist()) + "\n\n")
                grams, n = np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(n)], ["gram", "n"])

    return docs.select(text_of(text_col).alias("t")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Letters:
    """Costs (negative log probabilities) of a letter after two others, smoothed by the letter's own share."""

    letters: str
    costs: np.ndarray
    #: Of any letter that is not among them.
    rare: float = 0.0

    def __post_init__(self) -> None:
        self.place = {c: i + 2 for i, c in enumerate(self.letters)} | {" ": BORDER}
        self.size = len(self.letters) + 2
        self.flat = array("f", self.costs.astype(np.float32).tobytes())

    def __getstate__(self):
        return self.letters, self.costs, self.rare

    def __setstate__(self, state) -> None:
        self.letters, self.costs, self.rare = state
        self.__post_init__()

    @classmethod
    def of(cls, counts: dict[tuple[str, str, str], int], letters: str) -> Letters:
        """From counts of trigrams; " " is a border, "." any other character.  An unknown letter costs three times
        what any known one costs anywhere: a known letter in its place changes three trigrams, so it costs less."""
        place = {c: i + 2 for i, c in enumerate(letters)} | {" ": BORDER}
        cube = np.zeros((len(letters) + 2,) * 3)
        for (a, b, c), n in counts.items():
            cube[place.get(a, OTHER), place.get(b, OTHER), place.get(c, OTHER)] += n
        alone = cube.sum(axis=(0, 1)) + 1.0
        costs = -np.log((cube + 5 * alone / alone.sum()) / (cube.sum(axis=2, keepdims=True) + 5))
        return cls(letters, costs, 3 * float(costs.max()))

    def cost(self, text: str) -> float:
        x = y = BORDER
        total = 0.0
        for c in text:
            z = self.place.get(c, OTHER)
            total += self.rare if z == OTHER and c.isalpha() else self.flat[(x * self.size + y) * self.size + z]
            x, y = y, z
        return total


def language_model(docs: DataFrame, text_col: str = "text") -> Letters:
    """The trigrams of a to z and of the most frequent letters, taken from the table of all; every other letter
    counts as OTHER."""
    table = materialise(count_trigrams(docs, text_col), "trigrams")
    last = F.col("gram").bitwiseAND((1 << 21) - 1)
    common = table.where(last > 1).groupBy(last.alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(LETTERS).collect()
    letters = {chr(r.c) for r in common} | set(ascii_lowercase)
    order = sorted(letters)
    place = {ord(c): i + 2 for i, c in enumerate(order)}
    known = F.create_map(*(F.lit(x) for pair in (place | {BORDER: BORDER}).items() for x in pair))
    cell = lambda shift: F.coalesce(F.element_at(known, F.shiftright("gram", shift).bitwiseAND((1 << 21) - 1).cast("int")), F.lit(OTHER))
    # at most (LETTERS and a few dozen)^3 rows
    rows = table.groupBy(cell(42).alias("a"), cell(21).alias("b"), cell(0).alias("c")).agg(F.sum("n").alias("n")).collect()
    names = " ." + "".join(order)
    return Letters.of({(names[r.a], names[r.b], names[r.c]): r.n for r in rows}, "".join(order))


def lattice(token: str) -> list[list[str]]:
    """The readings of each run of equal characters of a token; GAP stands for a space between pieces."""
    readings = []
    for run in (m.group() for m in RUNS.finditer(token)):
        c, n = run[0], len(run)
        if c == GAP:
            readings.append(["", " "])
        elif c.isalpha():
            base = c if c.isascii() else ALIKE.get(b := unicodedata.normalize("NFKD", c)[:1].lower(), b)
            letters = c if base == c or not base.isalpha() else c + base
            readings.append([x * k for x in letters for k in range(1, min(n, 2) + 1)])
        elif c in IMITATES:
            readings.append([x * k for x in IMITATES[c] for k in range(1, min(n, 2) + 1)] + [run])
        else:
            # characters without width are never meant to be read
            readings.append([""] if unicodedata.category(c) in ("Cf", "Mn") else [run, ""] if c in SEPARATORS else [run])
    return readings


def viterbi(readings: list[list[str]], model: Letters) -> str:
    """The likeliest string; a reading that keeps a look-alike pays as a character that is no letter."""
    place, size, flat, rare = model.place, model.size, model.flat, model.rare
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BORDER, BORDER): (0.0, None)}
    for options in [*readings, [" "]]:
        then: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (paid, read) in states.items():
            for option in options:
                x, y, total = a, b, paid
                for c in option:
                    z = place.get(c, OTHER)
                    total += rare if z == OTHER and c.isalpha() else flat[(x * size + y) * size + z]
                    x, y = y, z
                if (x, y) not in then or total < then[x, y][0]:  # of equals, the first
                    then[x, y] = total, (read, option)
        states = then
    parts, read = [], min(states.values(), key=lambda s: s[0])[1]
    while read:
        read, option = read
        parts.append(option)
    return "".join(reversed(parts))[:-1]


@dataclass
class ToxicModel:
    """letters: the language model.  marks: weights of words and stems ("abc*") that mark toxic texts.
    curve: the regression's weights of the constant and of the evidence."""

    letters: Letters
    marks: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.watch({skeleton(m) for m in self.marks if m[-1] != "*"} | {skeleton(m) + "*" for m in self.marks if m[-1] == "*"})

    def __getstate__(self):
        return self.letters, self.marks, self.curve

    def __setstate__(self, state) -> None:
        self.letters, self.marks, self.curve = state
        self.__post_init__()

    def watch(self, keys: set[str]) -> None:
        """Sets the skeletons, and beginnings ("abc*") of skeletons, whose tokens are decoded."""
        self.whole = {k for k in keys if k[-1] != "*"}
        self.stems = {k[:-1] for k in keys if k[-1] == "*"}
        self.lengths = sorted({len(s) for s in self.stems})
        self.longest = max([*map(len, self.whole), *self.lengths], default=0)
        # pieces between spaces are put together for words of some length only
        self.prefixes = {w[:n] for w in self.whole if len(w) >= 4 for n in range(1, len(w))}
        # a token of letters and digits has to begin as a watched word does
        self.heads = {s[:2] for s in self.whole | self.stems}
        self.seen: dict[str, tuple[float, str]] = {}

    def suspect(self, token: str) -> bool:
        """Whether the token can be read as a watched word, or as one that begins with a watched stem."""
        return any(s in self.whole or any(s[:n] in self.stems for n in self.lengths) for s in skeletons(token, self.longest))

    def restore(self, token: str) -> str:
        """The likeliest reading of a lower-cased token with strong signs; any other token as it is."""
        bare = token if GAP in token else token.strip(EDGES)
        strong = GAP in token or STRONG.search(bare) and any(c.isalpha() for c in bare)
        return viterbi(lattice(bare), self.letters) if strong else token

    def words(self, token: str) -> set[str]:
        """The words of a token that its own letters and its likeliest readings give."""
        if GAP in token:
            words = set(WORD(viterbi(lattice(token), self.letters)))
            if all(len(t) == 1 for t in token.split(GAP)):  # a one-letter word may stand at an end
                whole = viterbi(lattice(token.replace(GAP, "")), self.letters)
                words |= {whole, whole[1:], whole[:-1], whole[1:-1]}
            return words
        bare, outer = token.strip(EDGES), token.strip(INNER)
        found = set(WORD(bare))
        for t in {bare, outer, outer.rstrip("!"), outer.lstrip("!")}:
            if t and not t.isdigit():
                found.update(WORD(viterbi(lattice(t), self.letters)))
        return found

    def marks_of(self, token: str) -> dict[str, str]:
        """The words of a token and their beginnings, with the word that each comes from."""
        words = self.words(token)
        return {w[:n] + "*": w for w in words for n in STEM if len(w) > n} | {w: w for w in words}

    def tokens(self, text: str) -> list[str]:
        """Lower-cased tokens; three and more single characters in a row make one token."""
        tokens = text.lower().split()
        single = [i for i, t in enumerate(tokens) if len(t) == 1 or len(t) < 5 and len(t.strip(EDGES)) == 1]
        if len(single) < 3:
            return tokens
        joined, i = [], 0
        for j in range(1, len(single) + 1):
            if j == len(single) or single[j] != single[j - 1] + 1:
                if j - i >= 3:
                    joined.append((single[i], single[j - 1] + 1))
                i = j
        for a, b in reversed(joined):
            tokens[a:b] = [GAP.join(t.strip(EDGES) or t for t in tokens[a:b])]
        return tokens

    def look(self, token: str) -> tuple[bool, str]:
        """Whether the token is to be decoded; its skeleton, if a watched word begins with it."""
        if GAP in token:
            return any(c.isalpha() for c in token), ""
        if token.isalnum() and len(head := skeleton(token[:4])[:2]) == 2 and head not in self.heads:
            return False, ""
        plain = skeleton(token.strip(EDGES))
        return self.suspect(token), plain if plain in self.prefixes else ""

    def pieces(self, tokens: list[str], i: int, begun: str) -> str | None:
        """Tokens from place i on, put together, if their skeletons make up a watched word."""
        whole = begun
        for j in range(i + 1, len(tokens)):  # each adds letters, or this ends
            if GAP in tokens[j]:
                return None
            more = skeleton(tokens[j].strip(EDGES))
            if not more:
                return None
            whole = _double.sub(r"\1", whole + more)
            if whole in self.whole:
                return GAP.join(t.strip(EDGES) for t in tokens[i : j + 1])
            if whole not in self.prefixes:
                return None
        return None

    def suspects(self, tokens: list[str]) -> Iterator[tuple[int, str]]:
        """Place and form of everything in the tokens that is to be decoded."""
        for i, token in enumerate(tokens):
            decode, begun = self.look(token)
            if decode:
                yield i, token
            if begun and (put := self.pieces(tokens, i, begun)):
                yield i, put

    def weight(self, token: str) -> float:
        """The largest weight of the marks of a token, 0 without any."""
        return max((self.marks.get(m, 0.0) for m in self.marks_of(token)), default=0.0)

    def evidence(self, text: str) -> tuple[float, float, float, float]:
        """Sum of the TOP largest weights of distinct tokens, the largest, the log length, weight for ten tokens."""
        tokens = self.tokens(text)
        seen, marked = self.seen, {}
        for i, token in enumerate(tokens):
            known = seen.get(token)
            if known is None:
                decode, begun = self.look(token)
                known = self.weight(token) if decode else 0.0, begun
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                if len(token) <= 64:
                    seen[token] = known
            if known[0]:
                marked[token] = known[0]
            if known[1] and (put := self.pieces(tokens, i, known[1])) and (w := self.weight(put)):
                marked[put] = w
        found = sorted(marked.values(), reverse=True)
        return sum(found[:TOP]), found[0] if found else 0.0, log(1 + len(tokens)), 10 * sum(found) / (1 + len(tokens))

    def restored(self, text: str) -> str:
        return " ".join(map(self.restore, self.tokens(text)))

    def score(self, text: str) -> float:
        x = sum(a * b for a, b in zip(self.curve, (1.0, *self.evidence(text))))
        return 1 / (1 + exp(-min(max(x, -50.0), 50.0)))


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small ridge; both labels weigh the same in all."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    rows = np.where(y > 0.5, max(1.0, (y <= 0.5).sum() / max(1, (y > 0.5).sum())), 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (rows * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (rows * (y - p)) - 0.5 * w), -3, 3)
    return tuple(w.tolist())


def lower_bound(hits: int, n: int, z: float = Z) -> float:
    """Wilson's lower confidence bound of hits / n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def may_learn(id_col: str | Column = "doc_id") -> Column:
    """Rows outside the held-out third: crc32 of the id as text mod 3 is not 1."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(key.cast("string")), F.lit(3)) != 1


def drawn(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` rows, by a hash of the key columns; all rows if there are no more."""
    n = df.count()
    return df if n <= most else df.where(F.shiftrightunsigned(F.xxhash64(F.lit(11), *key), 1) < max(1, int(most / n * 2**63)))


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """t, y of about ``train_docs`` labelled texts, each text of an id once for each of its labels."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__lp_id"), F.col(label_col).cast("int").alias("__lp_y")).distinct()
    some = F.broadcast(materialise(drawn(known, train_docs, "__lp_id", "__lp_y"), "toxic-labels"))  # train_docs rows of two numbers
    joined = docs.select(F.col(id_col).alias("__lp_d"), text_of(text_col).alias("t")).join(some, F.col("__lp_d") == F.col("__lp_id")).select("__lp_id", "t", F.col("__lp_y").alias("y"))
    # an id may hold very many texts
    return materialise(drawn(joined, train_docs, "__lp_id", "t").distinct().select("t", "y").repartition(32), "toxic-train")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train_docs: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicModel:
    """``labels`` (id, label 0/1) are taken as they are: leave held-out rows out before."""
    rows = training_rows(docs, labels, train_docs, id_col, text_col, label_col)
    model = ToxicModel(language_model(docs, text_col))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return model

    def packed(total: Counter[str], toxic: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([toxic[w] for w in total], pa.int64())], ["mark", "n", "hits"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        total: Counter[str] = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set().union(*map(keys_of, set(model.tokens(text))))
                total.update(found)
                if y:
                    toxic.update(found)
            if len(total) > 400_000:
                yield packed(total, toxic)
                total, toxic = Counter(), Counter()
        yield packed(total, toxic)

    sums = rows.mapInArrow(texts, "mark string, n bigint, hits bigint").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    # far above the share of toxic texts: few skeletons are
    model.watch({r.mark for r in sums.where(f"hits >= 4 AND hits > {MARK} * n").collect() if lower_bound(r.hits, r.n) >= MARK})
    watched = model.whole | {s + "*" for s in model.stems}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.watch(watched)
        for batch in batches:
            seen = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = ["", *model.tokens(text), ""]
                for i, form in model.suspects(tokens[1:-1]):
                    around = tokens[i] + " " + tokens[min(i + 2 + (form.count(GAP) if GAP not in tokens[i + 1] else 0), len(tokens) - 1)]
                    for m, word in model.marks_of(form).items():
                        if (skeleton(m) if m[-1:] != "*" else skeleton(m) + "*") in watched:
                            seen.add((m, skeleton(word)[: len(skeleton(m)) + 2], around, y))
            columns = zip(*seen) if seen else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["mark", "kind", "around", "y"])

    apart = rows.mapInArrow(contexts, "mark string, kind string, around string, y int").groupBy("mark", "kind", "around").agg(F.max("y").alias("y"))
    apart = materialise(apart, "toxic-marks")
    kinds: dict[str, list[tuple[int, int]]] = {}
    for r in apart.groupBy("mark", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).collect():
        kinds.setdefault(r.mark, []).append((r.hits, r.n))
    toxic, clean = sizes[1], sizes[0]
    beyond = lambda hits, n: hits >= 4 and lower_bound(hits, n) >= MARK
    marks = {}
    for r in apart.groupBy("mark", "around").agg(F.max("y").alias("y")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).collect():
        others = sorted(kinds[r.mark])[:-1]
        varied = sum(hits > 0 for hits, _ in others) >= KINDS - 1 and beyond(*map(sum, zip(*others)))
        if beyond(r.hits, r.n) and (r.mark[-1] != "*" or varied):
            marks[r.mark] = max(0.0, log((r.hits + 0.5) / (toxic + 1)) - log((r.n - r.hits + 0.5) / (clean + 1)))
    model = ToxicModel(model.letters, marks)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[i] for v in x], pa.float64()) for i in range(4)), batch.column(1)], ["a", "b", "c", "d", "y"])

    seen = rows.mapInArrow(weighed, "a double, b double, c double, d double, y int").toPandas()  # about train_docs rows of five numbers
    seen = seen.sort_values(["a", "b", "c", "d", "y"])  # one order, one result
    model.curve = fit_curve(seen[["a", "b", "c", "d"]].to_numpy(), (seen["y"] == 1).to_numpy(dtype=np.float64))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score (0 to 1), predicted (1 if the score is at least ``threshold``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], [id_col, "score"])

    rows = docs.select(F.col(id_col), text_of(text_col).alias("__lp_t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def deobfuscate(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text: the restored texts, lower-cased, tokens parted by one space."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.restored(t.as_py()) for t in batch.column(1)], pa.string())], [id_col, "text"])

    return docs.select(F.col(id_col), text_of(text_col).alias("__lp_t")).mapInArrow(run, f"`{id_col}` {kind}, text string")
