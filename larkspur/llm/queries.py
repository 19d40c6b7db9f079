"""The operators of this package applied with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import (
    decontamination,
    filter_audit,
    language_id,
    merkle,
    merkle_manifest,
    near_dedup,
    packing,
    quality,
    sharding,
    shared,
    suffix_dedup,
    token_counts,
    token_output,
    url_rules,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_output.token_digest(spark, path)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled bad where the label of the same number is toxic or of low quality.

    The tables hold no labels of pages; these are labels of documents, so what is mined here shows the method and says
    little about the pages.
    """
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_rules.judge(table(spark, sf_dir, "pages"), labels)


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in six parts, are compacted, and are read back from the last manifest."""
    store = sharding.ShardedTable(spark, shared.new_path(spark, "shards"))
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(6))
    for i in range(6):
        store.append(docs.filter(part == i))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_size_tiered_shards": op2_size_tiered_shards,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_rules": op5_url_rules,
    "op6_decontamination": op6_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_merkle_fingerprints": op9_merkle_fingerprints,
    "pipeline": pipeline,
    "op10_token_output": op10_token_output,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op2_size_tiered_shards": "select doc_id, lang, source, n_chars, md5(text) as text_md5 from documents",
    "op11_merkle_manifest": merkle_manifest.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
