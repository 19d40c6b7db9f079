"""Five stages that turn the documents table into packed training sequences.

Each stage takes what the one before kept. The first four return the columns of `documents`; packing returns
where each piece of each document goes. Further columns of the input are dropped by the first stage that reads it, under
whatever names. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, language_id, near_dedup, packing, suffix_dedup
from larkspur.llm.shared import Temporary, materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARE = 0.33  # of packing's usual slices and caches: the JVM of an executor has grown in the stages before
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; those without text or a letter go. Nothing is learned of an empty table,
    which stays empty."""
    return language_id.identified(docs.select(*COLUMNS))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Rows with equal doc_id are one document and stay or go together; rows without doc_id all stay.
    """
    copies = near_dedup.near_groups(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of smaller doc_id has are taken out of the texts; n_chars follows."""
    left = suffix_dedup.remove_repeats(docs, carry=("lang", "source"))
    n_chars = F.length("kept_text").cast("long").alias("n_chars")
    return left.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", n_chars)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, also those without doc_id; other texts of the same doc_id stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.find_leaks(docs, benchmark)
    leaks = leaks.select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    same = (F.xxhash64("text") == F.col("leak_hash")) & F.col("doc_id").eqNullSafe(F.col("leak_id"))
    return docs.select(*COLUMNS).join(leaks, same, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a null text is a piece of the end id alone, an empty table has no pieces."""
    return packing.pack(docs, TOKENIZER, share=SHARE)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
ORACLE_SQL = None  # components, suffix arrays and packing are beyond SQL; tests/llm/test_pipeline.py compares run() to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is deleted once the next one is written, as are the tables within stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Temporary() as tables:
            kept = tables.keep(materialize(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = kept
    return docs
