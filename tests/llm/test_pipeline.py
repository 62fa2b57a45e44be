"""The pipeline's stages against what they say."""

import corpus_pipeline
from loompanel.llm import minhash
from loompanel.llm.common import load

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    items = [r.text for r in load(spark, SF, "benchmark").collect()]
    now, names = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        gone = set(before) - set(after)
        assert set(after) <= set(before) and now.count() == len(after)
        if name == "quality":
            assert sum(labels.get(i) == 1 for i in gone) <= 2 and not any(labels.get(i) == 0 for i in after)
        if name == "exact_dedup":
            assert len(after) == len(set(before.values())) and all(min(j for j, t in before.items() if t == x) == i for i, x in after.items())
        if name == "near_dedup":
            sets = {i: set(minhash.shingles(minhash.word_hashes(t)).tolist()) for i, t in before.items()}
            alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            assert not any(alike(i, j) for i in after for j in after if i < j)
            assert all(any(alike(i, j) for j in before if j != i) for i in gone)
        if name == "decontaminate":
            assert {i for i, t in before.items() if any(x in t for x in items)} <= gone
        names.append(name)
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == set(after) and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, an empty table."""
    from pyspark.sql import functions as F

    item = load(spark, SF, "benchmark").first().text
    plain = load(spark, SF, "documents").join(load(spark, SF, "labels").where("quality = 1"), "doc_id").orderBy("doc_id").first().text
    rows = [(1, plain), (2, None), (3, ""), (4, plain + " " + "word " * 20_000), (5, plain), (5, plain), (None, plain + " more"), (None, plain + " more"), (6, "Before. " + item + " After."), (7, item), (7, plain + " seven"), (8, "  \n ")]
    clash = "id node band rep votes score kept keep_id __row shard t a b".split()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").alias("n_chars"), *(F.lit(1).alias(c) for c in clash)).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    exact = texts(stages["exact_dedup"](spark, df, SF))
    assert exact == sorted([(1, plain), (2, None), (4, rows[3][1]), (None, plain + " more"), (6, rows[8][1]), (7, item), (7, plain + " seven"), (8, "  \n ")], key=repr)
    clean = texts(stages["decontaminate"](spark, df, SF))
    assert clean == sorted(((i, t) for i, t in rows if item not in (t or "")), key=repr)
    near = stages["near_dedup"](spark, df, SF)
    assert near.columns == df.columns and {None, 1, 2} <= {i for i, _ in texts(near)} and sum(i == 1 for i, _ in texts(near)) == 1 and not {4, 5} & {i for i, _ in texts(near)}  # 4 repeats one shingle
    good = stages["quality"](spark, df, SF)
    assert good.columns == df.columns and not any(i in (2, 3, 8) for i, _ in texts(good))
    counted = stages["bpe"](spark, df, SF)
    assert counted.count() == len(rows) and counted.where("doc_id = 2").first().n_tokens == 0
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df.limit(0), SF)
        assert out.count() == 0 and (name == "bpe" or out.columns == df.columns)
