"""A training-corpus pipeline over ``documents``, stage by stage.

Each stage gets what its predecessor kept, as a Parquet table, and returns the
columns of ``documents``; the last returns the token digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, language, line_dedup, near_dedup, pieces
from maskwright.llm.queries import PIECE_BPE, tokenizer_file
from maskwright.llm.store import scratch, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language.keep_identified(docs, language.fit(docs.filter(~language.held_out())))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are taken out of the texts, and
    documents that were nothing else go; n_chars follows the text."""
    left = line_dedup.remove_repeats(docs, drop_empty=True, into=None)
    kind = docs.schema["n_chars"].dataType
    return left.withColumn("n_chars", F.length("text").cast(kind))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 0.8) stays."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark phrase of ten words go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return pieces.round_trip(docs, tokenizer_file(PIECE_BPE))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express the trained classifier, the winnowing or the encoder; the stages are tested by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):  # the stage's own tables go once its output is written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
