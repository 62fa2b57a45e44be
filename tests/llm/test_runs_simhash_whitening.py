"""SimHash classes, periodic runs and whitening against brute force and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loompanel.llm import queries, runs, simhash, whitening
from loompanel.llm.common import load

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit " * 4000
#: nulls, empty and very long texts, ties, repeated rows, a null id; extra columns with clashing names
ODD = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, LONG), (5, "Alpha beta gamma delta epsilon zeta"), (5, "Alpha beta gamma delta epsilon zeta"), (None, "eta theta"), (7, "   \n\t "), (8, "é日本語 𝒳 ﬁ\u0000x"), (9, "one"), (10, "ab " * 40 + "É é"), (11, "eta theta eta")]
CLASH = "id fp n tile home x runs collapsed best start length period component_id least root node unit side a b i v".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").select("*", *(F.lit(1).alias(c) for c in CLASH)).repartition(2)


# ---- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    fps = np.array(fps, dtype=np.uint64)
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            a, b = sorted((root(i), root(int(j))))
            group[b] = a
    best = {}
    for i, d in enumerate(ids):
        r = root(i)
        best[r] = min((x for x in (best.get(r), d) if x is not None), default=None)
    return [best[root(i)] for i in range(len(fps))]


def check_components(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, plain_components(fps, [d for d, _ in rows]))), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()), key=repr)
    assert got == want


def test_simhash_equals_brute_force(spark, odd):
    check_components(odd)
    # near copies: one word of many changed, so that chains of links arise
    pick = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = pick.choices(words, k=400)
        for _ in range(12):
            t = list(base)
            for _ in range(pick.randrange(4)):
                t[pick.randrange(400)] = pick.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    check_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_simhash_on_the_table(spark):
    check_components(load(spark, SF, "documents"))


def test_dense_groups_over_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "LANE", 8)
    monkeypatch.setattr(simhash, "CELLS", 64)
    pick = random.Random(3)
    centres = [pick.getrandbits(64) for _ in range(4)]
    fps = list({c ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for c in centres for _ in range(150)})
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, least bigint")
    links = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash._links(simhash._units(nodes, 2), 2).collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in links)
    want, got = plain_components(fps, fps), dict(zip(fps, fps))

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        got[y] = x
    assert [root(f) for f in fps] == want


def test_neighbouring_tiles_cover_the_radius():
    steps = set(simhash.steps(2))
    assert len(steps) == 21 and 0 in steps
    pick = random.Random(1)
    count = lambda f: sum(((f >> 16 * k & 0xFFFF).bit_count() + 4) * 32**k for k in range(4))
    for _ in range(2000):
        f = pick.choice([0, 2**64 - 1, pick.getrandbits(64)])
        g = f ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64))
        assert abs(count(f) - count(g)) in steps


# ---- periodic runs ---------------------------------------------------------------------------------


def plain_runs(words, least=24):
    """Every period tried at every place."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 3 * q):
                piece = words[i : i + length]
                if all(piece[p:] != piece[: length - p] for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found)


def fast_runs(words, least=24):
    """The same, whole arrays at a time."""
    w, n, found = runs.number(words), len(words), []
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]])
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            length = e - s + q
            if length >= max(least, 3 * q) and all(words[s + p : s + length] != words[s : s + length - p] for p in range(1, q) if q % p == 0):
                found.append((s, length, q))
    return sorted(found)


def test_runs_equal_brute_force():
    pick = random.Random(11)
    for case in range(400):
        letters = "ab" if case % 2 else "abcde"
        words = [pick.choice(letters) for _ in range(pick.randrange(60))]
        for _ in range(pick.randrange(5)):
            piece = [pick.choice(letters) for _ in range(pick.randrange(1, 12))]
            words += (piece * pick.randrange(1, 9))[: pick.randrange(1, 70)]
        for least in (24, 6, 7):
            got = runs.find_runs(runs.number(words), least)
            assert got == plain_runs(words, least), (words, least)
    for words in (["x"] * 5000, ["x", "y"] * 2500, (["x"] * 30 + ["y"]) * 40, [str(i % 7 if i < 900 else i) for i in range(2000)] * 3):
        assert runs.find_runs(runs.number(words)) == fast_runs(words)


def test_fibonacci_words_hold_nested_runs():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    found = runs.find_runs(runs.number(list(b)))
    assert found == fast_runs(list(b)) and len(found) > 10


def plain_row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = fast_runs(words)
    keep = [True] * n
    for s, length, q in found:
        keep[s + q : s + length] = [False] * (length - q)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for w, k in zip(words, keep) if k)))


@pytest.mark.parametrize("table", [SF, "/root/testdata/sf0.01"])
def test_periodic_runs_on_the_table(spark, table):
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, table).collect())
    want = sorted(plain_row(r.doc_id, r.text) for r in load(spark, table, "documents").collect())
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_periodic_runs_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in ODD), key=repr)
    assert runs.periodic_runs(odd.limit(0)).count() == 0
    assert runs.planted_tails(odd).columns == odd.columns


def test_runs_take_about_linear_time():
    import time

    for words in ([str(i) for i in range(300)] * 1000, ["x"] * 200_000, [str(i * i % 9973) for i in range(300_000)]):
        began = time.time()
        runs.find_runs(runs.number(words))
        assert time.time() - began < 30


# ---- whitening -------------------------------------------------------------------------------------


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_leading_components_equal_the_library(d):
    draw = np.random.default_rng(d)
    for case in range(6):
        x = draw.standard_normal((200, d)) * draw.uniform(0.1, 5, d)
        m = x.T @ x / 200
        if case == 1:
            m = np.diag(np.arange(1.0, d + 1))  # splits into blocks
        if case == 2:
            m = np.eye(d)  # one cluster
        if case == 3 and d > 3:
            q, _ = np.linalg.qr(draw.standard_normal((d, d)))
            m = q @ np.diag([5.0, 5.0 - 1e-9, 5.0 - 2e-9, *np.linspace(0.1, 1, d - 3)]) @ q.T  # close values
        if case == 4:
            m = np.zeros((d, d))
        if case == 5:
            m = m * 1e-9
        k = min(4, d)
        values, vectors = whitening.leading_components(m, k)
        want = np.linalg.eigvalsh(m)[::-1][:k]
        scale = max(np.abs(m).max(), 1e-300)
        assert np.abs(values - want).max() <= 1e-12 * scale
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-9
        assert np.abs(m @ vectors.T - vectors.T * values).max() <= 1e-11 * scale


def test_sturm_counts():
    draw = np.random.default_rng(2)
    a, b = draw.standard_normal(30), draw.standard_normal(29)
    t = np.diag(a) + np.diag(b, 1) + np.diag(b, -1)
    at = np.linspace(-4, 4, 100)
    assert (whitening.sturm_count(a, b, at) == [(np.linalg.eigvalsh(t) < x).sum() for x in at]).all()


def plain_whitening(rows, k=4):
    rows = [(i, [math.floor(float(c) * 256) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit.astype(float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    out = []
    for i, x in rows:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        for c, o in enumerate(order):
            w = (np.array(x, dtype=float) - np.array([s / n for s in sums])) @ vectors[:, o] / math.sqrt(values[o])
            out.append((i, c + 1, n, deviation, w, values[o] / values.sum()))
    return out


@pytest.mark.parametrize("table", [SF, "/root/testdata/sf0.01"])
def test_whitening_equals_the_library(spark, table):
    rows = [(r.vec_id, r.embedding) for r in load(spark, table, "embeddings").collect()]
    got = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, table).collect()}
    want = plain_whitening(rows)
    assert len(got) == len(want) == 4 * len(rows)
    signs = {}
    for i, c, n, deviation, w, share in want:
        r = got[i, c]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - share) < 1e-9 and r.identity_error < 1e-9
        sign = signs.setdefault(c, 1 if abs(w - r.whitened) < abs(w + r.whitened) else -1)
        assert abs(w - sign * r.whitened) < 1e-7


def test_whitening_on_odd_rows(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0, -0.25 * i]) for i in range(20)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    rows = [*good, good[3], (None, good[4][1]), (50, [-0.0, 0.0, 1.0, -0.0]), *bad]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in CLASH))
    got = sorted(whitening.whiten(df).collect(), key=repr)
    usable = [r for r in rows if r[0] is None or r[0] < 100]
    want = plain_whitening(usable, 3)  # the third entry has no variance
    assert len(got) == 4 * len(usable)
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got if r.component < 3 and r.vec_id is not None) == sorted(x[:4] for x in want if x[1] < 3 and x[0] is not None)
    assert all(r.whitened is None for r in got if r.component == 4) and all(abs(r.identity_error) < 1e-9 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 100 AND vec_id < 104")).count() == 0
    alone = whitening.whiten(df.where("vec_id = 3")).collect()
    assert len(alone) == 8 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in alone)
