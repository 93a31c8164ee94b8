"""I1, I3 and I4 over a stored history of any size: only what a batch touches is read and written.

The history lies in folders by a hash of the source key. A batch's keys name the folders it needs; these alone are read (a partition
filter) and written anew. A run that dies in between can be run again: the newest row of a source wins whoever writes it, and a removal finds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import work_dir
from . import history as H


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 256):
        """columns: the rows' schema, ``seq`` and ``source_file`` in it. ``buckets`` is fixed with the first batch."""
        self.spark, self.path, self.columns, self.buckets = spark, path, columns, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(H.source_key(F.col("source_file"))), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The folders of some rows, ``buckets`` at most."""
        return sorted(r.bucket for r in self._placed(rows).select("bucket").distinct().collect())

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The history, or what it has in some folders."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], self.columns)
        found = self.spark.read.schema(f"{self.columns}, bucket int").parquet(self.path)
        return (found if buckets is None else found.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def _write(self, rows: DataFrame, buckets: list[int]) -> None:
        """Folders of ``buckets`` get these rows and no others. They are stored elsewhere first, since they come from the same folders."""
        new = work_dir(self.spark)
        self._placed(rows).write.partitionBy("bucket").parquet(new)
        left = self.spark.read.schema(f"{self.columns}, bucket int").parquet(new)
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        kept = {r.bucket for r in left.select("bucket").distinct().collect()}
        sc = self.spark.sparkContext
        for bucket in set(buckets) - kept:  # nothing is left of these
            folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)

    def upsert(self, new: DataFrame) -> list[int]:
        """A row for each source, the newest by ``seq``. The folders that were written."""
        buckets = self.touched(new)
        if buckets:
            self._write(H.history_upsert(self.rows(buckets), new.select(*self.rows([]).columns)), buckets)
        return buckets

    def remove(self, sources: DataFrame) -> list[int]:
        """I4: without the rows of some sources."""
        buckets = self.touched(sources)
        if buckets:
            self._write(H.history_remove(self.rows(buckets), sources), buckets)
        return buckets

    def new_sources(self, sources: DataFrame, force: bool = False) -> DataFrame:
        """The sources that the history hasn't, read in their folders only."""
        return sources if force else H.skip_processed(sources, self.rows(self.touched(sources)))
