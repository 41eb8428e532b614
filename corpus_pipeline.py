"""A corpus pipeline of five stages; each works on all that the one before it kept.

Rows that the quality rules reject go; of near duplicates the smallest doc_id
stays; documents that hold benchmark passages go; secrets are masked; the rest
is packed into sequences. Every stage's result is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import near_sets, packing, positional_index, robust_quality, runtime, secret_ledger


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rows that pass the base rules and aren't outliers of their language and source."""
    return robust_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on five-word shingles: one document of each group of texts that share 0.8 or more of them, by verified links."""
    return near_sets.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 against the benchmark table: documents that aren't contaminated."""
    return positional_index.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all documents, secrets masked in text."""
    return secret_ledger.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of the packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("secret scans", mask_secrets), ("packing", pack)]

#: MCD estimates, similar sets and tokenizers have no SQL form; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents table."""
    folder = runtime.work_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = runtime.written(docs, folder, f"stage{k}")
            if k:
                runtime.delete_folder(spark, f"{folder}/stage{k - 1}")
    return docs
