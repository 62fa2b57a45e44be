"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loompanel.llm.bpe import bpe_round_trip, digests
from loompanel.llm.common import load, text_of
from loompanel.llm.decontaminate import contamination
from loompanel.llm.exact_dedup import exact_duplicates
from loompanel.llm.html_extract import extract_text
from loompanel.llm.license_scan import license_scan, license_scan_sql
from loompanel.llm.minhash import near_duplicates
from loompanel.llm.quality import fit_quality, score_quality
from loompanel.llm.runs import periodic_runs, planted_tails, strongest
from loompanel.llm.sharding import external_shuffle
from loompanel.llm.simhash import simhash_components
from loompanel.llm.token_counts import count_tokens
from loompanel.llm.toxicity import fit_toxicity, may_learn, score_toxicity
from loompanel.llm.whitening import whiten


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), threshold=0.8)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = external_shuffle(load(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=8)
    return shuffled.select(
        "doc_id",
        (F.octet_length(text_of()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, load(spark, sf_dir, "labels").where(may_learn()))
    return score_toxicity(docs, model, threshold=0.7).select("doc_id", (~may_learn()).alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_round_trip(load(spark, sf_dir, "documents"), "byte_bpe_50k.json"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"), keep="max")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"), radius=2)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_tails(load(spark, sf_dir, "documents").select("doc_id", "text")), least=24)
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"), k=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_near_dedup, op2_sharding, op3_toxicity, op4_quality, op5_bpe, op6_html_extraction, op7_decontamination, op8_license, op9_token_counts, op10_exact_dedup, op11_simhash, op12_periodic_runs, op13_whitening)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_license": license_scan_sql(),
        "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
    }
