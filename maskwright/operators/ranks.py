"""Ranks inside groups of any size.

A window would bring a whole group to one task. Here rows are dealt out by ranges of (group, order), so that a group may lie over
many tasks; each task counts on within itself, and what a group has in earlier ranges is added afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import work_dir


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: str, order: list[str], rank: str, keep: Callable[[DataFrame], DataFrame] = stored, partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2 ... inside each value of ``group`` (a number or text, none null),
    in ascending ``order``, nulls first; rows alike in all of these get different ranks in any order.

    The ranges are stored (``keep``), so that ranks don't change when a task is run again. What comes to the driver is one row for each range.
    """
    spark = df.sparkSession
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(group), *[F.col(x).asc_nulls_first() for x in order], F.col("_tie")]
    dealt = tied.repartitionByRange(partitions, *keys) if partitions else tied.repartitionByRange(*keys)
    rows = dealt.sortWithinPartitions(*keys).drop("_tie")
    to = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(group).to_numpy(zero_copy_only=False)
            heads = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            local = np.arange(len(g)) - np.repeat(heads, np.diff(np.append(heads, len(g))))
            if g[0] == last:
                local[: heads[1] if len(heads) > 1 else None] += seen
            last, seen = g[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(local, pa.int64())], names=to.names)

    table = keep(rows.mapInArrow(count, to))
    edges = table.groupBy("_part").agg(F.min(group).alias("first"), F.max(F.struct(group, "_local")).alias("last")).orderBy("_part").collect()
    carried, ahead, last = [], 0, None
    for edge in edges:
        same = edge["first"] == last
        if same:
            carried.append((edge["_part"], last, ahead))
        ahead = edge["last"]["_local"] + 1 + (ahead if same and edge["last"][group] == last else 0)
        last = edge["last"][group]
    kind = df.schema[group].dataType.simpleString()
    before = spark.createDataFrame(carried, f"_part int, _group {kind}, _ahead long")  # a row a range at most
    met = table.join(F.broadcast(before), (table["_part"] == before["_part"]) & (table[group] == before["_group"]), "left")
    return met.select(*[table[c] for c in df.columns], (table["_local"] + F.coalesce("_ahead", F.lit(0))).alias(rank))
