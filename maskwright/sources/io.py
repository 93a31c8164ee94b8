"""Routing by format, reading, and writing results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = (".docx", ".xlsx", ".pdf")


def work_dir(spark: SparkSession) -> str:
    """A new folder name in the folder all executors share, ``spark.checkpoint.dir``; where that is
    unset and the session is local (tests, a laptop), in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/maskwright-{uuid.uuid4().hex}"


def route_by_format(files: DataFrame, name: str = "filename") -> DataFrame:
    """``files`` with ``file_type`` (null if not supported) and ``reason`` of a rejection."""
    ext = F.lower(F.regexp_extract(F.col(name), r"\.[^./]+$", 0))
    known = ext.isin(*FORMATS)
    reason = F.when(~known, F.when(ext == "", "no extension").otherwise(F.concat(F.lit("unsupported format: "), ext)))
    return files.withColumn("file_type", F.when(known, F.substring(ext, F.lit(2), F.length(ext)))).withColumn("reason", reason)


def read_corpus(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A corpus table from parquet, json or csv files, or one row for each text file."""
    if kind == "text":
        rows = spark.read.text(path, wholetext=True)
        return rows.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    return reader.format(kind).load(path)


def _to(path: str, mode: str, run: str | None) -> tuple[str, str]:
    """Where a sink writes, and how: a named run has a folder of its own, which is written anew when the run is repeated."""
    return (path, mode) if run is None else (f"{path}/run={run}", "overwrite")


def write_masked(masked: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """S3: masked documents, by file type if the table has it. With ``run`` (a job's or batch's name) a repeated write leaves no second row."""
    to, mode = _to(path, mode, run)
    writer = masked.write.mode(mode)
    (writer.partitionBy("file_type") if "file_type" in masked.columns else writer).parquet(to)


def write_json_reports(reports: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """H1's rows as JSON lines. ``run`` as in ``write_masked``."""
    to, mode = _to(path, mode, run)
    reports.select("report").write.mode(mode).text(to)


def write_txt_reports(reports: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """H2's rows as text blocks. ``run`` as in ``write_masked``."""
    to, mode = _to(path, mode, run)
    reports.select("report").write.mode(mode).text(to, lineSep="\n\n")
