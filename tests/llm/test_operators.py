"""The training-data operators against brute force and on edge cases."""

import hashlib
import html
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loompanel.llm import bpe, decontaminate, exact_dedup, html_extract, license_scan, minhash, quality, sharding, token_counts, toxicity
from loompanel.llm.common import load, split_by_ids

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 4000
#: nulls, empty and very long texts, ties, repeated rows, a null id; extra columns with clashing names
ODD = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, LONG), (5, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (None, "eta theta"), (7, "   \n\t "), (8, "é日本語 𝒳 ﬁ\u0000x")]
CLASH = "ids n_tokens score kept shard slot __row label text_sha256 keep_id bucket start end edits class_id row id t a b".split()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH)).repartition(2)


@pytest.fixture(scope="module")
def docs(spark):
    return load(spark, SF, "documents")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_groups(spark, odd):
    got = rows_of(exact_dedup.exact_duplicates(odd, keep="max"), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    want = []
    for i, t in ODD:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def test_colliding_hashes_part(spark, odd):
    weak = exact_dedup.exact_duplicates(odd, hash_of=lambda t: F.lit(b"0"))
    assert rows_of(weak, "doc_id", "keep_id", "group_size") == rows_of(exact_dedup.exact_duplicates(odd), "doc_id", "keep_id", "group_size")


def test_exact_filter(spark, odd):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns
    assert rows_of(out, "doc_id", "text") == sorted([(1, ODD[0][1]), (2, None), (4, LONG), (None, "eta theta"), (7, "   \n\t "), (8, ODD[8][1])], key=repr)


def test_split_by_ids_is_a_cover(spark, docs):
    ids = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("x"))
    maybe, sure = split_by_ids(docs, ids, "doc_id")
    assert maybe.columns == docs.columns and maybe.count() + sure.count() == docs.count()
    assert sure.where("doc_id % 7 = 0").count() == 0 and maybe.where("doc_id % 7 = 0").count() == ids.count()


def test_split_by_many_ids_moves_texts_once(spark, docs, odd, monkeypatch):
    """With no bit map at all: the same results, and one exchange of whole rows in the split."""
    from loompanel.llm import common

    want = [rows_of(exact_dedup.exact_duplicates(d), "doc_id", "keep_id", "group_size", "kept") for d in (docs, odd)]
    stay = rows_of(exact_dedup.drop_exact_duplicates(docs), "doc_id")
    near = rows_of(minhash.near_duplicates(docs), "doc_id", "class_id")
    monkeypatch.setattr(common, "MAP_MOST", 1)
    written = []
    real = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    assert [rows_of(exact_dedup.exact_duplicates(d), "doc_id", "keep_id", "group_size", "kept") for d in (docs, odd)] == want
    assert rows_of(exact_dedup.drop_exact_duplicates(docs), "doc_id") == stay
    assert rows_of(minhash.near_duplicates(docs), "doc_id", "class_id") == near
    splits = [plan for name, plan in written if name == "split"]
    assert len(splits) >= 4 and all(plan.count("Join ") == 1 for plan in splits)
    ids = docs.select("doc_id").where("doc_id % 3 = 0").union(docs.limit(1).select(F.lit(None).cast("bigint")))
    inside, outside = split_by_ids(docs.select("doc_id", "text").union(odd.select("doc_id", "text")), ids, "doc_id")
    assert inside.where("doc_id % 3 <> 0").count() == 0 == outside.where("doc_id % 3 = 0 AND doc_id > 11").count() and inside.count() + outside.count() == docs.count() + odd.count()


def test_sharding_law(spark, odd, docs):
    for df in (odd, docs):
        out = sharding.external_shuffle(df, 8, bucket_bytes=50_000).collect()
        counts = Counter(r.shard for r in out)
        assert len(out) == df.count() and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in df.collect())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.external_shuffle(docs.repartition(7), 8, bucket_bytes=50_000).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out}
    assert sharding.external_shuffle(docs.limit(0)).count() == 0
    assert zlib.crc32(b"") == 0


def test_equal_rows_are_split(spark, monkeypatch):
    """A third of the rows equal in id and text: no bucket holds them all, and the law holds."""
    monkeypatch.setattr(sharding, "COPIES", 50)
    monkeypatch.setattr(sharding, "PARTITIONS", 3)  # tasks take several buckets
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(None).cast("int").alias("__row"))
    seen = []
    keep = sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda d, name: seen.append(keep(d, name)) or seen[-1])
    out = sharding.external_shuffle(df, 4, bucket_bytes=1000)
    buckets = seen[-1].groupBy("__lp_bucket").count().collect()
    assert len(buckets) > 10 and max(b["count"] for b in buckets) < 600
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "__row", "shard", "slot"] and Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(750))
    for other in (df.repartition(5), df.orderBy(F.desc("id" if "id" in df.columns else "doc_id")).coalesce(2)):  # in any layout
        again = sharding.external_shuffle(other, 4, bucket_bytes=1000).collect()
        assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.text, r.shard, r.slot) for r in rows)


def test_the_shuffle_replayed(spark):
    """Scatter, order and Fisher-Yates of a small table by hand."""
    df = spark.createDataFrame([(i, f"text {i % 17} " * (i % 5)) for i in range(200)], "doc_id bigint, text string").repartition(3)
    size = sum(len(r.text) + 1 for r in df.collect())
    n = -(-size // 400)
    tie, salt = F.xxhash64("text"), F.lit(0).cast("long")
    dealt = df.select("doc_id", "text", tie.alias("tie"), F.pmod(F.xxhash64(F.lit(17), "doc_id", tie, salt), F.lit(n).cast("long")).alias("bucket")).collect()
    place, want = 0, {}
    for bucket in range(n):
        rows = sorted((r for r in dealt if r.bucket == bucket), key=lambda r: (r.doc_id, r.tie))
        for k, at in enumerate(sharding.fisher_yates(len(rows), (17 << 32) ^ bucket).tolist()):
            want[rows[at].doc_id] = ((place + k) % 8, (place + k) // 8)
        place += len(rows)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(df, 8, bucket_bytes=400).collect()} == want


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400 and sharding.fisher_yates(0, 1).tolist() == []


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    own = bpe.Bpe("byte_bpe_50k.json")
    r = random.Random(2)
    texts = ["".join(r.choice("ab  aac'sst\n\t<|endoftext|>é日1") for _ in range(r.randint(0, 120))) for _ in range(300)] + ["a" * n for n in range(60)] + [LONG, "x<|endoftext|> y"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        packed = own.encode(t)
        assert packed == struct.pack(f"<{len(ids)}I", *ids) and own.decode(packed) == lib.decode(ids, skip_special_tokens=False)
    trip = bpe.bpe_round_trip(odd).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in trip) == sorted((i or 0, t or "") for i, t in ODD)
    enc = bpe.bpe_encode(odd)
    assert rows_of(bpe.bpe_decode(enc), "doc_id", "text") == sorted([(i, t or "") for i, t in ODD], key=repr)
    assert bpe.bpe_round_trip(odd.limit(0)).count() == 0


@pytest.mark.parametrize("path", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, odd, docs, path):
    if path.endswith(".model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_file(path))
        count = lambda t: len(lib.encode(t))
    else:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(bpe.tokenizer_file(path))
        count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for df in (odd, docs):
        got = rows_of(token_counts.count_tokens(df, path, table_words=500), "doc_id", "n_bytes", "n_tokens", "over_limit")
        want = [(r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > 4096) for r in df.collect()]
        assert got == sorted(want, key=repr)
    table = {"ab": 3, "é ": 1, "\n": 2}
    assert token_counts.unpack(token_counts.pack(table)) == table


def brute_classes(rows, threshold=0.8):
    sets = [set(minhash.shingles(minhash.word_hashes(t or "")).tolist()) for _, t in rows]
    words = [minhash.word_hashes(t or "").tobytes() for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] == rows[j][0]
            if words[i] == words[j] or same_id or both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates_equal_brute_force(spark, docs, odd):
    r = random.Random(5)
    base = [w for w in "one two three four five six seven eight nine ten".split() for _ in range(9)]
    r.shuffle(base)
    made = [(1000, " ".join(base))]
    for i in range(1, 25):  # a drifting chain: neighbours are alike, the ends are not
        base = base.copy()
        base[r.randrange(len(base))] = f"w{i}"
        made.append((1000 + i, " ".join(base)))
    rows = [(d.doc_id, d.text) for d in docs.collect()] + made
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(minhash.near_duplicates(df), "doc_id", "class_id") == brute_classes(rows)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len({c for _, c in brute_classes(rows)})
    known = [(i, t) for i, t in ODD if i is not None]
    assert rows_of(minhash.near_duplicates(odd).where("doc_id IS NOT NULL"), "doc_id", "class_id") == brute_classes(known)
    assert minhash.near_duplicates(odd).count() == len(ODD) and minhash.near_duplicates(odd.limit(0)).count() == 0
    assert minhash.drop_near_duplicates(odd).columns == odd.columns


def test_signature_estimates_probability_jaccard():
    x, y = np.arange(1, 101, dtype=np.uint64), np.arange(21, 121, dtype=np.uint64)
    agree = []
    for shift in range(0, 20_000, 1000):
        element = minhash.mix(np.concatenate([x, y]) + np.uint64(shift))
        s = minhash.prob_minhash(np.repeat([0, 1], 100), element, np.ones(200), 2)
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(80 / 120, abs=0.03)


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_edit_distance(spark, odd):
    bench = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()][:12]
    items = decontaminate.Items([*bench, (99, None), (98, "Zq")])
    r = random.Random(3)
    for _ in range(60):
        n = r.randrange(len(bench))
        code = decontaminate.fold(bench[n][1])[0]
        letters = [chr(c) for c in code]
        budget = int(items.budget[n])
        for _ in range(r.randint(0, budget + 2)):
            p, o = r.randrange(len(letters)), r.random()
            if o < 0.4:
                letters[p] = r.choice("abcdefgh")
            elif o < 0.7:
                del letters[p]
            else:
                letters.insert(p, r.choice("abcdefgh"))
        text = "qwer TYUI! " * r.randint(0, 3) + "".join(letters) + " zxcv bnm" * r.randint(0, 3)
        d = edit_distance_inside("".join(map(chr, code)), "".join(map(chr, decontaminate.fold(text)[0])))
        found = [m for m in items.find(text) if m[0] == bench[n][0]]
        assert bool(found) == (d <= budget) and (not found or min(m[3] for m in found) == d)
    assert [m[0] for m in items.find("so zq, it")] == [98] and items.find("") == [] and items.find("zqx") == []
    b = spark.createDataFrame([*bench, (99, None)], "item_id bigint, text string")
    assert decontaminate.contamination(odd, b).count() == 0 and decontaminate.drop_contaminated(odd, b).count() == len(ODD)
    hit = odd.withColumn("text", F.lit("Before. " + bench[0][1].upper() + " after"))
    assert decontaminate.drop_contaminated(hit, b).count() == 0 and decontaminate.contamination(hit, b, block_bytes=500).count() == len(ODD)
    assert decontaminate.contamination(odd.limit(0), b).columns == ["doc_id", "item_id", "start", "end", "edits"]


def test_many_blocks_one_after_another(spark, docs, odd, monkeypatch):
    """A benchmark in twenty blocks gives what one block gives, with one block's table in a worker at a time."""
    bench = load(spark, SF, "benchmark")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0]
    names = ("doc_id", "item_id", "start", "end", "edits")
    written = []
    real = decontaminate.materialise
    monkeypatch.setattr(decontaminate, "materialise", lambda df, name: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    for df in (docs, odd):
        whole = rows_of(decontaminate.contamination(df, bench), *names)
        kept = rows_of(decontaminate.drop_contaminated(df.select(docs.columns[:2]), bench), "doc_id", "text")
        assert not written
        assert rows_of(decontaminate.contamination(df, bench, block_bytes=-(-size // 20)), *names) == whole
        assert rows_of(decontaminate.drop_contaminated(df.select(docs.columns[:2]), bench, block_bytes=-(-size // 20)), "doc_id", "text") == kept
        assert len(written) >= 38 and all(plan.count("MapInArrow") == 1 for plan in written)
        written.clear()
    assert len(whole) == 0 < decontaminate.contamination(docs, bench).count()


def test_a_shared_stem_costs_little():
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    stem = "which of the following statements is true about "
    made = [(i, stem + " ".join(r.choice(words) for _ in range(16))) for i in range(200)]
    items = decontaminate.Items(made)
    text = " ".join(stem + " ".join(r.choice(words) for _ in range(6)) for _ in range(50))
    began = time.process_time()
    assert items.find(text) == []
    assert time.process_time() - began < 2
    close = made[9][1].replace("e", "q", 5)
    assert [(m[0], m[3]) for m in items.find(f"{text} {made[7][1]} and {close}")] == [(7, 0), (9, 5)]


def test_short_and_repetitive_items(monkeypatch):
    short = [(1, "tick"), (2, "a"), (3, "tick"), (4, "bcdefgh")]
    items = decontaminate.Items(short)
    assert [m[:3] for m in items.find("Tick a ticks bcdefgh-a")] == [(1, 0, 4), (2, 5, 6), (2, 21, 22), (3, 0, 4), (4, 13, 20)]
    assert len(items.find("tick " * 5000)) == 10_000
    many = decontaminate.Items([(1, "ab" * 40), (2, "abc" * 30), (3, "the quick brown fox jumps over the lazy dog")])
    text = "ab" * 300 + " the quick brown fox jumps over a lazy dog " + "abc" * 200
    whole = many.find(text)
    monkeypatch.setattr(decontaminate, "ENTRIES", 500)  # in many pieces
    monkeypatch.setattr(decontaminate, "CELLS", 5000)
    assert many.find(text) == whole and {m[0] for m in whole} == {1, 2, 3}


def test_license_places(spark, odd):
    texts = [(1, "CC BY cc-by 4.0; All Rights Reserved. all rights, reserved"), (2, "the GNU General Public License"), (3, "cc  by"), (4, "ccby all rights"), (5, "Released under the  MIT license."), (6, "Licensed under the Apache Software License, Version 2.0"), (7, "Kcc by"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    for i, t in texts:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(p, k) for k, ph in phrases.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at)) and r.base_labels == ",".join(sorted({k for _, k in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r.score <= 1
    assert "mit" in got[5].labels and "apache-2.0" in got[6].labels and got[None].labels == ""
    want = [(i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())), 0, None, "", 0.0) for i, t in ODD]
    assert rows_of(license_scan.license_scan(odd), "doc_id", "n_words", "n_base", "first_word", "labels", "score") == sorted(want, key=repr)
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_siblings_are_told_apart(spark):
    """Each identifier and each phrase gives its own label and, besides base ones, no other."""
    texts = [(f"// SPDX-License-Identifier: {name}", {name.lower()}) for name in license_scan.SPDX]
    texts += [(phrase, {label}) for label, phrase, base in license_scan.TEMPLATES if not base]
    texts += [
        ("Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc-4.0"}),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", {"cc-by-nc-sa-4.0"}),
        ("Creative Commons Attribution-NonCommercial-Something 4.0 International License", set()),
        ("the GNU Affero General Public License", {"agpl-3.0"}),
        ("SPDX-License-Identifier: Beerware", set()),
        ("SPDX-License-Identifier: GPL-2.0-or-later and then SPDX-License-Identifier: MIT", {"gpl-2.0-or-later", "mit"}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    bases = {label for label, _, base in license_scan.TEMPLATES if base}
    got = {r.doc_id: set(filter(None, r.labels.split(","))) - bases for r in license_scan.license_scan(df).collect()}
    wrong = [(t, want, got[i]) for i, (t, want) in enumerate(texts) if got[i] != want]
    assert not wrong and len(license_scan.SPDX) == 47
    with pytest.raises(ValueError, match="stands whole"):
        license_scan.obligatory([("a", "some licence text", False), ("b", "by some licence text of", False)])


def test_license_spans_are_verified(spark):
    mit = next(p for label, p, _ in license_scan.TEMPLATES if label == "mit-text").split()
    texts = [
        (1, "licensed under under the the apache apache license license version version 2 2 0"),  # drifts away
        (2, "SPDX-License-Identifier: BSD-3-Clause"),
        (3, "x y " + " ".join(mit[:30] + ["really"] + mit[30:])),  # a long template, one word more
        (4, " ".join(mit[:20] + mit[:20] + mit[:20])),  # a beginning only
        (5, "GNU General Public License version 3 and general public license, version 2"),
    ]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(2)
    got = {r.doc_id: r.labels for r in license_scan.license_scan(df).collect()}
    assert got == {1: "", 2: "bsd-3-clause", 3: "mit-text", 4: "", 5: "gpl,gpl-2.0,gpl-3.0"}
    spans = {(r.id, r.label): (r.first, r.last, r.share) for r in license_scan.license_spans(df).collect()}
    assert spans[3, "mit-text"][:2] == (2, 2 + len(mit)) and 0.95 < spans[3, "mit-text"][2] < 1 and spans[2, "bsd-3-clause"] == (0, 5, 1.0)


@pytest.fixture(scope="module")
def page_model():
    return html_extract.fit_tree_model(html_extract.labelled_pages())


def test_html_on_held_out_pages(spark, page_model):
    model = page_model
    right = 0
    for page in html_extract.labelled_pages(100, seed=99):
        tree = html_extract.parse(page)
        gold = "\n\n".join(t for i, (t, _) in sorted(tree.blocks.items()) if tree.mark[tree.parent[i]])
        right += model.extract(page.replace(' data-main="1"', "")) == gold
    assert right >= 88
    page = '<nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two&nbsp;three.<p><b>Four<br>five</b><script>var x="</p>";</script></article><footer>&copy; me</footer>'
    assert model.extract(page) == "A & B\n\nOne two three.\n\nFour five"
    odd = [(1, "u", None, ""), (2, None, "", ""), (3, "u", "<p", "<p"), (4, "u", "<" * 50_000, "<" * 50_000), (4, "u", "</p></div>text", "text"), (5, "u", "<a " + '"' * 61, "<a " + '"' * 61), (6, "u", "<p class='a>b'>x</p>" + "<a '" * 300, None), (None, "u", page, model.extract(page))]
    df = spark.createDataFrame([r[:3] for r in odd], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    out = html_extract.extract_text(df, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = rows_of(out.where("page_id <> 6 OR page_id IS NULL"), "page_id", "url", "text", "n_chars")
    assert got == sorted(((i, u, t, len(t)) for i, u, _, t in odd if t is not None), key=repr)
    assert out.count() == 8 and html_extract.extract_text(df.limit(0), model).count() == 0


def test_html_on_pages_made_by_hand(page_model):
    """Layouts that no rule of the training pages draws as they are: one form around all, lists of links, names that
    mislead or say nothing, no names at all."""
    texts = ["The harbour was rebuilt after the storm of 1953, with stones from the old mill.", "Today it serves fishermen, ferries and a few sailing schools.", "In winter the quay is empty, but the lights are kept on."]
    body, title = "".join(f"<p>{t}</p>" for t in texts), "The harbour and the river"
    whole = "\n\n".join([title, *texts])
    top = '<div id="menu"><a href="/">Home</a><a href="/a">About</a></div>'
    essays = [f"An essay about the winters of the harbour, part {i}" for i in range(6)]
    listed = "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(essays))
    voices = "".join(f"<div><b>{n}</b><p>I liked this text very much. Thank you for it.</p></div>" for n in ("Ann", "Bob", "Cay"))
    pages = {
        f'<form id="aspnetForm" method="post">{top}<div><h1>{title}</h1>{body}</div></form>': whole,
        f'<form method="post" action="./"><h1>{title}</h1>{body}</form>': whole,
        f"<article><h1>{title}</h1><ul>{listed}</ul></article>": "\n\n".join([title, *essays]),
        f'<article><div class="head-line"><h1>{title}</h1></div>{body}<div class="tags"><p>We discuss tags.</p></div></article>': whole + "\n\nWe discuss tags.",
        f'<article><h1>{title}</h1>{body}</article><div class="user-posts"><h3>What readers say</h3>{voices}</div>': whole,
        f'<div><a href="/">Home</a> <a href="/a">About</a></div><div><h1>{title}</h1>{body}</div><div>Copyright 2020 Foo Inc.</div>': whole,
        f'<div><a href="/">Home</a> <a href="/a">About</a></div><h1>{title}</h1>{body}<div>Copyright 2020 Foo Inc.</div>': whole,
        f'<header><h1>My site</h1></header><nav><a href="/">Home</a></nav><main><h1>{title}</h1>{body}</main><aside><h3>More</h3><ul><li><a href="/1">One</a></li></ul></aside><section><h3>3 replies</h3><article><p>Nice text, thanks.</p></article></section><footer>Foo, 2020</footer>': whole,
        f'<div class="cookie-bar">We use cookies. <a href="/c">More</a></div><div id="content"><h2>{title}</h2>{body}</div><div class="sidebar"><p>Our other texts.</p></div>': whole,
        f'<table><tr><td class="nav"><a href="/">Home</a><br><a href="/x">News</a></td><td class="main"><h1>{title}</h1>{body}</td></tr></table>': whole,
    }
    got = {page: page_model.extract(f"<html><body>{page}</body></html>") for page in pages}
    wrong = [(page, got[page]) for page, want in pages.items() if got[page] != want]
    assert len(wrong) <= 1, wrong


def test_html_keeps_what_stands_deep(page_model):
    text = [f"Paragraph {i} says some words, and more." for i in range(10)]
    for depth in (0, 2, 4, 20):
        for n in (1, 3, 10):
            inner = "<div>" * depth + "".join(f"<p>{t}</p>" for t in text[:n]) + "</div>" * depth
            assert page_model.extract(f"<nav><a href='/'>Home</a></nav><article>{inner}</article><footer>Us</footer>") == "\n\n".join(text[:n])
    assert page_model.extract("<article><header><h1>Title of it</h1></header><p>Text follows here.</p></article>") == "Title of it\n\nText follows here."
    assert page_model.extract("<article><p>Main text, with words.</p><button>Share</button></article><div class='responses'><div><p>I like this very much, thanks.</p></div></div>") == "Main text, with words."
    assert page_model.extract("<article><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p><noscript><p>Rest stays, of course.</p></article>") == "We have x=2 here.\n\nRest stays, of course."


@pytest.mark.parametrize("piece", ["<a ", "<span></b>", '<a =">" ="', "<div>", "<p><td><blockquote>", "<!--", "<noscript>", "<a", "<ul><li>", "&x"])
def test_html_takes_linear_time(page_model, piece):
    page = "<i><p>" + piece * (300_000 // len(piece))
    began = time.process_time()
    for end in ("", ">"):
        page_model.extract(page + end)
    assert time.process_time() - began < 4


def test_html_equals_an_independent_reading_of_all_pages(spark):
    """The articles of the given pages, cut out and split by patterns."""

    def read(page):
        inside = re.search("<article>(.*?)</article>", page or "", re.DOTALL)
        body = re.sub('<script.*?</script>|<div class="ad">.*?</div>|<aside.*?</aside>', "", inside.group(1) if inside else "", flags=re.DOTALL)
        blocks = re.split(r"</?(?:p|h[1-6]|li|ul|ol|div|blockquote|table|tr|td|figure|section|pre)\b[^>]*>", body)
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        return "\n\n".join(b for b in plain if b)

    pages = load(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    assert got == {r.page_id: read(r.html) for r in pages.collect()}


def test_sum_product_equals_enumeration():
    tree = html_extract.parse("<div class='x'><p>One two.</p><div class='ad'><p>three</p></div></div>")
    model = html_extract.fit_tree_model(html_extract.labelled_pages(30))
    n = len(tree.parent)
    seen = html_extract.observed(tree)
    total, content = 0.0, [0.0] * n
    for bits in range(2**n):
        s = [bits >> i & 1 for i in range(n)]
        p = model.root[s[0]]
        for i in range(n):
            for table, v in zip(*((model.node[seen[i][0]], seen[i][1]) if seen[i] else ((), ()))):
                p *= table[s[i]][v]
            if i:
                pair = model.pair[html_extract.cases(tree)[i]] if seen[i] or i in tree.blocks else html_extract.STRAIGHT
                p *= pair[s[tree.parent[i]]][s[i]]
        total += p
        content = [c + p * x for c, x in zip(content, s)]
    assert model.marginals(tree) == pytest.approx([c / total for c in content])


def test_quality_on_labels(spark, odd):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit_quality(docs)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05
    assert all(0.5 < a <= 1 for a in model.labels.accuracy().values())
    assert quality.keep_quality(docs, model).columns == docs.columns
    assert quality.score_quality(odd, model).count() == len(ODD) and quality.keep_quality(odd, model).columns == odd.columns
    assert quality.score_quality(odd.limit(0), quality.fit_quality(odd.limit(0))).count() == 0


def brute_quality(rows, rounds=60, steps=300):
    """Votes, label model and scorer document by document, with plain loops and a dense matrix."""

    def vote(t):
        w = t.split()
        if not w:
            return [2] * 9
        n, big = len(w), len(w) >= 20
        symbols = sum(c in quality.SYMBOLS for c in t) / len(t)
        capitals = sum(x.isupper() for x in w) / n
        repeats = sum(w[i] == w[i - 1] for i in range(1, n)) / n
        variety = len(set(w)) / n
        marks = sum(len(re.findall(re.escape(m), t)) for m in ("!!", "??", "**", "$$", "%%", "##", "&&", "...")) / n
        bars = sum(x == "|" for x in w) / n
        short = sum(len(x) < 4 for x in w) / n
        ends = (len(re.findall(r"\. |\.\n|! |\? ", t)) + 1) / n
        mean = (len(t) - n + 1) / n
        return [
            0 if symbols > 0.08 else 1 if symbols < 0.02 else 2,
            0 if capitals > 0.5 and n >= 5 else 1 if capitals < 0.1 else 2,
            0 if repeats > 0.3 and n >= 5 else 1 if repeats < 0.05 else 2,
            0 if variety < 0.15 and big and n < 2000 else 1 if variety > 0.4 else 2,
            0 if marks > 0.3 and n >= 3 else 1 if marks < 0.02 else 2,
            0 if bars > 0.2 else 1 if bars < 0.01 else 2,
            0 if short < 0.05 and big else 1 if short > 0.15 or not big else 2,
            1 if ends > 0.02 else 2,
            0 if mean > 14 and big else 1 if 3 < mean < 10 else 2,
        ]

    texts = [t for _, t in rows]
    seen = [vote(t) for t in texts]
    good = [0.1 if 0 in v else 0.9 if 1 in v else 0.5 for v in seen]
    for _ in range(rounds):
        prior = min(max((sum(good) + 1) / (len(texts) + 2), 1e-3), 1 - 1e-3)
        table = [[[0.1] * 3 for _ in range(2)] for _ in range(9)]
        for v, g in zip(seen, good):
            for j, k in enumerate(v):
                table[j][0][k] += 1 - g
                table[j][1][k] += g
        table = [[[x / sum(row) for x in row] for row in t] for t in table]
        odds = [[p * float(np.prod([table[j][c][k] for j, k in enumerate(v)])) for c, p in ((0, 1 - prior), (1, prior))] for v in seen]
        good = [b / (a + b) for a, b in odds]

    def shape(word):
        runs = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        return xxhash.xxh3_64_intdigest("".join(c for i, c in enumerate(runs) if i == 0 or runs[i - 1] != c)) % 8192

    def row(t):
        w = t.split()
        x = np.zeros(8192)
        for i, word in enumerate(w):
            x[shape(word)] += 1
            x[(min(len(word), 15) * 101 + 3) % 8192] += 1
            if i:
                x[(shape(w[i - 1]) * 31 + shape(word) * 17 + 7) % 8192] += 1
                x[11 if word == w[i - 1] else 13] += 1
        x = np.sqrt(x / max(1, len(w)))
        return x / np.sqrt((x**2).sum()) if w else x

    x = np.stack([row(t) for t in texts])
    known = {d: (r, g) for d, r, g in zip(rows, x, good) if d[1].split()}  # each text of an id once
    a, y = np.stack([r for r, _ in known.values()]), np.array([g for _, g in known.values()])
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-3), 0.5 / max((y < 0.5).mean(), 1e-3))
    weight /= weight.sum()
    w, m, s = np.zeros(8193), np.zeros(8193), np.zeros(8193)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -60, 60)))
        g = np.append(a.T @ ((p - y) * weight) + 1e-5 * w[:-1], ((p - y) * weight).sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        w = w - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    score = np.where([bool(t.split()) for t in texts], 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -60, 60))), 0.0)
    return ["".join(map(str, v)) for v in seen], good, score.tolist()


def test_quality_equals_brute_force(spark, docs, odd):
    for df in (docs.select("doc_id", "text"), odd):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        votes, weak, score = brute_quality(rows)
        want = sorted(((i, v, g, s) for (i, _), v, g, s in zip(rows, votes, weak, score)), key=repr)
        got = rows_of(quality.score_quality(df, quality.fit_quality(df)), "doc_id", "votes", "weak_label", "score")
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-6) and np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-3)


def test_the_draw_for_training_holds_at_any_size():
    for n in (10**4, 10**9, 6 * 10**9, 10**13):
        assert quality.draw_below(6000 / n) / 2**63 == pytest.approx(6000 / n, rel=1e-3)
    assert quality.draw_below(1e-30) == 1


def test_em_recovers_accuracies():
    r = np.random.default_rng(1)
    y = r.random(20_000) < 0.8
    k = len(quality.LABELLERS)
    accuracy = np.linspace(0.65, 0.95, k)
    right = r.random((len(y), k)) < accuracy
    votes = np.where(right, y[:, None], ~y[:, None]).astype(int)
    counts = Counter("".join(map(str, v)) for v in votes)
    found = list(quality.fit_label_model(counts).accuracy().values())
    assert np.abs(np.array(found) - accuracy).max() < 0.03


def test_toxicity_on_held_out_labels(spark, odd):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit_toxicity(docs, labels.where(toxicity.may_learn()))
    held = toxicity.score_toxicity(docs, model).join(labels.where(~toxicity.may_learn()), "doc_id").collect()
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.03 and np.mean([r.predicted for r in held if r.toxic]) > 0.75
    assert model.restored("You 1d10t, stuuupid m.o.r.o.n") == "you idiot stupid moron"
    assert model.evidence("what a i d i o t !")[0] > 0 == model.evidence("what")[0]
    assert model.restored("the 42nd of May") == "the 42nd of may"
    out = toxicity.score_toxicity(odd, model)
    assert rows_of(out, "doc_id", "score") == sorted(((i, model.score(t or "")) for i, t in ODD), key=repr) and all(0 <= r.score < 0.7 for r in out.collect())
    assert rows_of(toxicity.deobfuscate(odd, model), "doc_id", "text") == sorted(((i, model.restored(t or "")) for i, t in ODD), key=repr) and toxicity.score_toxicity(odd.limit(0), model).count() == 0
    empty = toxicity.fit_toxicity(odd.select("doc_id", "text").limit(0), labels.limit(0))
    assert 0 <= empty.score("") <= 1


#: Plain English with words that begin as insults do.
PAGE = """The train left the station a little after seven, and the morning light lay on the fields beside the track. I had brought a book of essays about the history of the harbour town, but I read only a page before the words began to swim, so I looked out of the window instead. A woman across the aisle was peeling an orange; her son, who may have been six, asked whether the moon could see us in the day. She told him that it could, if the clouds were kind, and he was satisfied with that.

We passed the old mill and the lower bridge, where men were mending the stones after the winter floods. Somebody had painted the railings green again. At the next stop a group of students came in with muddy boots and a large map, and they discussed the best path over the ridge. One of them said the western route was longer but more pleasant, because of the woods; another thought the distance did not matter so long as they reached the hut before dark. They were loud, but nobody minded, and the boy with the orange listened as though it were a story.

By noon the weather had turned. Rain ran down the glass in long crooked lines, and the hills disappeared one after another. I thought of my sister, who works in the studio near the market, and of the letter she had written about the patients she draws there on Thursdays: how patient they are, how they study their own hands as if they belonged to strangers. The world seemed wide and worn and worth the journey. When the train stopped at last I put the book away, wished the family a good trip, and walked out into the wet street to look for something warm to eat."""


def test_plain_words_and_hidden_ones_under_the_fitted_model(spark):
    """The model of the largest table: held-out labels, plain words that share a beginning with an insult, and
    letters and characters that the corpus does not hold."""
    big = "/root/testdata/sf0.1"
    texts, labels = load(spark, big, "documents").select("doc_id", "text"), load(spark, big, "labels")
    model = toxicity.fit_toxicity(texts, labels.where(toxicity.may_learn()))
    plain = ["we go to work in the world every day and see the new words", "the travel agency was in train traffic", "a patient path to the party", "the idea of an idiom", "stupendous weather and studio", "the moral of a moraine", "a display of disks and distance", PAGE]
    assert len(PAGE.split()) >= 300 and all(model.score(t) < 0.7 for t in plain)
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "idiot")
    bold = "".join(chr(ord(c) - ord("a") + 0x1D41A) for c in "idiot")
    for hidden in ("idiot", wide, bold, "id\u200biot", "i\u2060d\u00adiot", "1d10t", "i d i o t", "і" + "d" + "і" + "о" + "t", "m0r0n", "STUPID"):
        assert model.score(f"you are {hidden} my friend") >= 0.7, hidden
    held = labels.where(~toxicity.may_learn()).join(toxicity.score_toxicity(texts, model), "doc_id").where("toxic IS NOT NULL")
    n = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.92 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 5 and n[0, 0] > 1000


def test_an_unknown_letter_never_wins():
    """Against the letter that it imitates, whatever stands around it."""
    pick = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(pick.choices(letters[:9], k=pick.randrange(2, 7))) for _ in range(300)]
    counts = Counter(g for w in words for g in zip("  " + w, " " + w, w + " "))
    model = toxicity.Letters.of(counts, letters)
    for _ in range(200):
        word = "".join(pick.choices(letters, k=pick.randrange(1, 8)))
        wide = "".join(chr(ord(c) + 0xFEE0) if pick.random() < 0.5 else c for c in word)
        assert not any(0xFF00 <= ord(c) for c in toxicity.viterbi(toxicity.lattice(wide), model)), wide


def test_viterbi_equals_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    letters = "abdeiklostu"
    counts = {(x, y, z): int(r.integers(0, 50)) for x in letters + " ." for y in letters + " ." for z in letters + " ."}
    model = toxicity.Letters.of(counts, letters)
    for token in ("1d10t", "aab44", "5tu", "b00k", "i-d", f"i{toxicity.GAP}d{toxicity.GAP}o", "іде"):
        lattice = toxicity.lattice(token)
        best = min(model.cost("".join(p) + " ") for p in product(*lattice))
        assert model.cost(toxicity.viterbi(lattice, model) + " ") == pytest.approx(best)


def test_trigram_table_equals_a_plain_count(spark, docs, odd):
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            t = "\n\n" + "".join(" " if c.isspace() else (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "." for c in r.text or "") + "\n\n"
            t = t.replace("\n", " ")
            want.update((t[i], t[i + 1], t[i + 2]) for i in range(len(t) - 2))
        name = lambda c: " " if c == 0 else "." if c == 1 else chr(c)
        got = {(name(r.gram >> 42), name(r.gram >> 21 & (1 << 21) - 1), name(r.gram & (1 << 21) - 1)): r.n for r in toxicity.count_trigrams(df).collect()}
        edge = (" ", " ", " ")  # borders between texts depend on the batches
        assert {k: n for k, n in got.items() if k != edge} == {k: n for k, n in want.items() if k != edge}


def template_group(n, planted, seed=3):
    """Texts that share six sevenths of their shingles (similarity 0.75), and copies of some of similarity above 0.8."""
    r = random.Random(seed)
    shared = " ".join(f"t{i}" for i in range(244))
    rows = [(i, shared + " " + " ".join(f"u{r.randrange(10**9)}" for _ in range(40))) for i in range(n)]
    for k in range(planted):  # the last 18 of the own words are new, those before are the same
        words = rows[2 * k + 1][1].split(" ")
        rows.append((n + k, " ".join(words[:-18] + [f"v{r.randrange(10**9)}" for _ in range(18)])))
    return rows


def test_near_duplicates_in_a_large_template_group(spark, monkeypatch):
    rows = template_group(300, 30)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute_classes(rows)
    assert len({c for _, c in expected}) == 300
    assert rows_of(minhash.near_duplicates(df), "doc_id", "class_id") == expected
    monkeypatch.setattr(minhash, "BLOCK", 1 << 13)  # many blocks
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    assert rows_of(minhash.near_duplicates(df), "doc_id", "class_id") == expected


def test_overlaps_equal_set_arithmetic():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    rows, columns = np.arange(8), np.arange(5, 20)
    assert minhash.overlaps(sets, rows, columns).tolist() == [[len(set(sets[i]) & set(sets[j])) for j in columns] for i in rows]


def test_near_duplicates_with_a_passage_repeated_often(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"p{i}" for i in range(60)] * 500)), (3, " ".join(f"o{i}" for i in range(400)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, _, (x, y, _) = minhash.sketches([t for _, t in rows])
    x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
    assert (x == y).mean() > 0.7  # the sets' similarity is 396 / 460
    assert rows_of(minhash.near_duplicates(df), "doc_id", "class_id") == brute_classes(rows)


def test_ids_with_several_texts_are_one_document(spark):
    """Their classes join, and none of their texts is lost."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = b.replace("b39", "z")
    rows = [(5, a), (5, b), (3, near), (7, a), (8, c), (8, c), (9, c)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(minhash.near_duplicates(df), "doc_id", "class_id") == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (8, 8), (9, 8)] == brute_classes(rows)
    assert rows_of(minhash.drop_near_duplicates(df), "doc_id", "text") == [(3, near), (8, c)]
    alone = spark.createDataFrame([(5, a), (5, b), (5, b)], "doc_id bigint, text string")
    assert rows_of(minhash.drop_near_duplicates(alone), "doc_id", "text") == [(5, a), (5, b)]


def test_components_equal_union_find(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = rows_of(minhash.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3)), "node", "root")
    assert got == sorted(((x, root(x)) for x in parent if root(x) != x), key=repr)
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_recall_on_sampled_ids(spark):
    """Near copies of similarity 0.8 and more of every twentieth document, against all documents."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    sets = {i: set(minhash.shingles(minhash.word_hashes(t)).tolist()) for i, t in rows}
    cls = {r.doc_id: r.class_id for r in minhash.near_duplicates(load(spark, sf, "documents")).collect()}
    alike = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 5 and all(cls[i] == cls[j] for i, j in alike)


@pytest.fixture(scope="module")
def insults():
    counts = Counter()
    for word in "idiot stupid moron ass letter well known book".split():
        t = f"  {word} "
        for i in range(len(t) - 2):
            counts[t[i], t[i + 1], t[i + 2]] += 100
    letters = "".join(sorted(set("abcdefghijklmnopqrstuvwxyz")))
    return toxicity.ToxicModel(toxicity.Letters.of(counts, letters), {"idiot": 3.0, "stupid": 3.0, "moron": 3.0, "ass": 3.0})


def test_hidden_words_of_each_form_are_decoded(insults):
    hidden = "iidiot stuupid mmoronn !diot idiot!! a$$ @$$ i-d-iot id.iot i--d--i--o--t 1d-i0t mor0n m0ron moro-n іdiot іԁіоt ìdïöt ｉｄｉｏｔ stuuuuupid".split()
    assert [t for t in hidden if not insults.evidence(t)[0]] == []
    for said in ("what i. d. i. o. t. said", "what i d i o t said", "a i d i o t", "what id iot said", "such m oron s", "i. d-i o t said"):
        assert insults.evidence(said)[0] == 3.0, said
    for said in ("letter", "well-known book", "455 2024 1st", "as so", "the id of it", "mor on and on", "ｉ"):
        assert insults.evidence(said)[0] == (3.0 if said.startswith("mor") else 0.0), said
    assert insults.restored("letter well-known") == "letter well-known"
    assert insults.restored("You 1d10t, stuuupid m.o.r.o.n 10.12 1.2.3") == "you idiot stupid moron 10.12 1.2.3"


def test_the_gate_loses_no_reading(insults):
    """What the gate passes over, decoding would not read as a marked word."""
    r = random.Random(4)
    for _ in range(3000):
        word = list(r.choice("idiot stupid moron ass letter well known book".split()))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(word))
            word[i] = r.choice([word[i] * 2, word[i] + r.choice(".-_*"), r.choice("013457@$!|x"), word[i].upper(), ""])
        token = "".join(word).lower()
        if not insults.suspect(token):
            assert insults.weight(token) == 0.0, token


def test_training_rows_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, None), (None, 1)], "doc_id int, toxic int")
    df = spark.range(40_000).select(F.when(F.col("id") < 30_000, 1).otherwise(F.col("id") % 50).cast("int").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    n = toxicity.training_rows(df, labels, 2000, "doc_id", "text", "toxic").count()
    assert 1700 < n < 2300
    twice = df.limit(10).union(df.limit(10)).coalesce(1)
    assert toxicity.training_rows(twice, labels, 2000, "doc_id", "text", "toxic").count() == twice.distinct().count()
