"""The run history and incremental runs. Sources are equal when their paths
are, in lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def source_key(c: Column) -> Column:
    return F.lower(c)


def history_upsert(history: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """One row for each source, the newest by ``seq``. A grouped maximum, combined
    before the shuffle, so a source with very many runs is no hot group."""
    rows = history if new is None else history.unionByName(new)
    whole = F.struct("seq", *[c for c in rows.columns if c != "seq"])
    return rows.groupBy(source_key(F.col("source_file")).alias("_key")).agg(F.max(whole).alias("r")).select(*[f"r.{c}" for c in rows.columns])


def history_list(history: DataFrame) -> DataFrame:
    """The newest first."""
    return history.orderBy(F.desc("seq"))


def _keys(history: DataFrame) -> DataFrame:
    return history.select(source_key(F.col("source_file")).alias("_key")).distinct()


def skip_processed(sources: DataFrame, history: DataFrame, force: bool = False) -> DataFrame:
    """The sources that aren't in the history, or all of them if forced."""
    if force:
        return sources
    known = _keys(history)
    return sources.join(known, source_key(sources["source_file"]) == known["_key"], "left_anti")


def already_processed(sources: DataFrame, history: DataFrame) -> DataFrame:
    known = _keys(history)
    return sources.join(known, source_key(sources["source_file"]) == known["_key"], "left_semi")


def history_remove(history: DataFrame, sources: DataFrame) -> DataFrame:
    """I4: the history without the rows of the given sources."""
    gone = _keys(sources)
    return history.join(gone, source_key(history["source_file"]) == gone["_key"], "left_anti")


def split_name(path: Column) -> tuple[Column, Column]:
    """Stem and extension of the file name at the end of a path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def versioned_names(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """``sources(seq, source_file)`` with ``masked_name``: ``<stem>_masked<ext>``, then ``_v2``,
    ``_v3``, ..: the smallest free numbers, in ``seq`` order, each given once. ``existing(name)``.

    Ranks, not windows, so a stem of very many files is no hot group. If t is the j-th taken number of a stem, t - j free ones lie before it; so
    the k-th free number is the place of k among all k and all t - j + 1 (these first where they are equal).
    """
    stem, ext = split_name(F.col("source_file"))
    rows = sources.withColumn("_name", F.concat(stem, F.lit("\0"), ext))
    wanted = ranked(rows.filter("_name is not null"), "_name", ["seq"], "_k")
    pattern = r"(?s)^(.*)_masked(?:_v([0-9]+))?(\.[^.]*)?$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    number = F.when(part(2) == "", 1).when(part(2).rlike("^[1-9]"), part(2).try_cast("long")).alias("t")
    taken = existing.filter(F.col("name").rlike(pattern)).select(F.concat(part(1), F.lit("\0"), part(3)).alias("_name"), number, (part(2) == "1").alias("one"))
    taken = taken.filter("t is not null and not one").select("_name", "t").distinct().join(rows.select("_name").distinct(), "_name", "left_semi")
    blocked = ranked(taken, "_name", ["t"], "_j").select("_name", (F.col("t") - F.col("_j")).alias("_at"), F.lit(False).alias("_asks"))
    every = wanted.withColumn("_at", F.col("_k") + 1).withColumn("_asks", F.lit(True)).unionByName(blocked, allowMissingColumns=True)
    placed = ranked(every, "_name", ["_at", "_asks"], "_v").filter("_asks").withColumn("_v", F.col("_v") + 1)
    parts = F.split("_name", "\0", -1)
    name = F.concat(parts[0], F.lit("_masked"), F.when(F.col("_v") > 1, F.concat(F.lit("_v"), F.col("_v").cast("string"))).otherwise(""), parts[1])
    return placed.select(*sources.columns, name.alias("masked_name"))


def artifact_paths(history: DataFrame, listing: DataFrame) -> DataFrame:
    """(seq, source_file, n_paths, n_present): the non-blank output paths of each row and how
    many of them ``listing(path)`` has."""
    rows = history.select("seq", "source_file", F.explode(F.array("masked", "report_json", "report_txt")).alias("path")).filter("length(path) > 0")
    there = listing.select("path", F.lit(1).alias("there")).distinct()
    rows = rows.join(there, "path", "left")
    return rows.groupBy("seq", "source_file").agg(F.count("*").alias("n_paths"), F.count("there").alias("n_present"))
