"""U1 with a store: a prompt is asked once, whatever becomes of the job.

Answers are kept by the SHA-256 of their prompt. A run asks each distinct prompt that has no answer yet, once however many rows have it; what failed is
stored too, and asked again by the next run only. Prompts go in *waves*: each is a job of its own whose answers are
in the store when it ends, so a run that is killed loses the wave it is in and nothing before.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.io import work_dir

STORE = "key string, raw string, error string, asked_at timestamp"


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, raw, error): for each prompt its answer, or how it failed last."""
    try:
        rows = spark.read.schema(STORE).parquet(path)
    except AnalysisException:  # no run has stored anything yet
        rows = spark.createDataFrame([], STORE)
    best = F.max(F.struct(F.col("error").isNull().alias("done"), "asked_at", "raw", "error")).alias("b")
    return rows.groupBy("key").agg(best).select("key", "b.raw", "b.error")


def asked_with_patience(model: Callable[[pd.Series], pd.Series], attempts: int = 3, pause: float = 1.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches of (key, prompt) to (key, raw, error). A batch that fails is asked row by row; a row that fails is asked
    ``attempts`` times in all, with pauses that double and vary."""

    def one(prompt: pd.Series) -> tuple[str | None, str | None]:
        for attempt in range(attempts):
            try:
                return list(model(prompt))[0], None
            except Exception as e:  # whatever the model raises belongs to its row
                failed = f"{type(e).__name__}: {e}"
                if attempt + 1 < attempts:
                    time.sleep(pause * 2**attempt * random.uniform(0.5, 1.5))
        return None, failed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = [(x, None) for x in model(batch["prompt"])]
            except Exception:
                found = [one(batch["prompt"].iloc[i : i + 1]) for i in range(len(batch))]
            yield pd.DataFrame({"key": batch["key"], "raw": [x for x, _ in found], "error": [e for _, e in found]})

    return run


def answer_with_store(requests: DataFrame, model: Callable[[pd.Series], pd.Series], path: str, waves: int = 8, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """``requests`` with ``raw`` and ``error``. ``path`` is the store, a folder that runs share; null prompts aren't asked and have neither."""
    spark = requests.sparkSession
    key = F.sha2(F.col("prompt"), 256)
    answered = stored_answers(spark, path).filter("error is null")
    missing = requests.filter("prompt is not null").select(key.alias("key"), "prompt").dropDuplicates(["key"]).join(answered, "key", "left_anti")
    queue = work_dir(spark)
    missing.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int")).write.partitionBy("wave").parquet(queue)
    waiting = spark.read.schema("key string, prompt string, wave int").parquet(queue)
    for wave in sorted(r.wave for r in waiting.select("wave").distinct().collect()):
        asked = waiting.filter(F.col("wave") == wave).select("key", "prompt").mapInPandas(asked_with_patience(model, attempts, pause), "key string, raw string, error string")
        asked.withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(path)
    met = requests.withColumn("_key", key).join(stored_answers(spark, path).withColumnRenamed("key", "_key"), "_key", "left")
    return met.select(*requests.columns, "raw", "error")
