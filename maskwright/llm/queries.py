"""The registered queries of the operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language, licenses, line_dedup, main_text, near_dedup, pieces, prefix_trie, quality, sharding, token_files, whitening

BYTE_BPE, PIECE_BPE, END_ID = "byte_bpe_50k.json", "piece_bpe_32k.model", 2


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark, sf_dir):
    return token_files.tokenised(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), END_ID)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_BPE))


def op6_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_main_text(spark, sf_dir):
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_decontamination, op2_token_files, op3_exact_dedup, op4_license_scan, op5_sentencepiece,
        op6_language_id, op7_near_dedup, op8_line_dedup, op9_quality, op10_main_text, op11_prefix_trie, op12_whitening, op13_sharding,
    ]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}
