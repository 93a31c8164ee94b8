"""New documents and sources as they arrive.

A batch's rows go to a folder of its number, ``run=<stream>/batch=<number>``, which is written anew when the batch is repeated
after a failure: no row is there twice. The stream's part of the name comes from its checkpoint's path, so that another stream may write beside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history as H
from ..plans.deidentify import deidentify


def batch_writer(target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``make`` of a batch's rows, in the batch's own folder under ``target``."""
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(rows: DataFrame, number: int) -> None:
        make(rows).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return write


def _started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def mask_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, types: list[str] | None = None, **trigger) -> StreamingQuery:
    """Masks the parquet files that appear in ``source``; ``doc_id, masked`` (and the folders' ``run, batch``) is what
    ``target`` then holds. A document's dictionary comes from that document alone, so no state is kept between batches.
    ``trigger`` as in ``writeStream.trigger``, by default all that is there."""
    write = batch_writer(target, checkpoint, lambda rows: deidentify(rows, types=types).masked.select("doc_id", "masked"))
    return _started(spark.readStream.schema(schema).parquet(source), write, checkpoint, trigger)


def first_seen(sources: DataFrame, history: DataFrame | None = None, time: str | None = None, delay: str = "7 days") -> DataFrame:
    """I3 on a stream of ``sources(source_file, ...)``: each source once, and none that ``history`` has. The keys seen so far are the stream's state: all of
    them, or with a column ``time`` those of the last ``delay``, after which a source counts as new."""
    rows = sources if history is None else H.skip_processed(sources, history)
    rows = rows.withColumn("_key", H.source_key(F.col("source_file")))
    rows = rows.dropDuplicates(["_key"]) if time is None else rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"])
    return rows.drop("_key")


def sources_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, history: DataFrame | None = None, time: str | None = None, delay: str = "7 days", **trigger) -> StreamingQuery:
    """The sources that appear in ``source`` for the first time, under ``target``."""
    stream = first_seen(spark.readStream.schema(schema).parquet(source), history, time, delay)
    return _started(stream, batch_writer(target, checkpoint, lambda rows: rows), checkpoint, trigger)
