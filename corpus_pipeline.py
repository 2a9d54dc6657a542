"""Corpus pipeline: the stages run in order over ``documents``, each written as Parquet and read again.

Defined results: a null text counts as empty (the quality rules drop texts of under 50 words); of rows with one
id, or of equal rows, one is left by the near-dedup; a null id is kept as any other; an empty table gives no
rows; extra columns of any name pass through all stages but the last, which returns ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from insight.llm import byte_bpe, decontamination, quality_rules, simhash
from insight.llm.storage import stage_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rule or the learned list rejects go."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.only_kept(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document of the smallest id stays of each group."""
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark window go."""
    return decontamination.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding: ids and digests of every document that is left."""
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Several stages (the learned list, XXH64 fingerprints, BPE) can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage reads what the one before it has written."""
    folder = stage_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
