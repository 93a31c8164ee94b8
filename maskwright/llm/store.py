"""Where intermediate tables go: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: folders of the open scratch blocks of this thread, the innermost last
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a session that leaves the setting unset (tests, a laptop) gets a
    temporary folder of its own, which is then set for later calls.
    """
    if _OPEN.get():
        return f"{_OPEN.get()[-1]}/{uuid.uuid4().hex}"
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/maskwright-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The rows of ``df`` as a Parquet table in the shared folder, and its path: work is done
    once, lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    return stored(df, name)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's own, whatever the file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside the block are deleted at its end: what is made of them
    has to be written, elsewhere, before."""
    folder = shared_dir(spark)
    before = _OPEN.set((*_OPEN.get(), folder))
    try:
        yield
    finally:
        _OPEN.reset(before)
        drop(spark, folder)


def spread(df: DataFrame, partition_bytes: int = 128 << 20) -> int:
    """How many partitions to deal ``df`` out to: as Spark is set, more if its estimated size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, wanted, min(-(-size // partition_bytes), 1_000_000 if size < 1 << 50 else wanted))
