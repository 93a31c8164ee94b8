"""The dictionary value -> mask of each document, and what it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the order of entities: chunk by chunk, by place within a chunk
ORDER = ("chunk_no", "start_pos", "end_pos")


def build_replacements(entities: DataFrame) -> DataFrame:
    """(doc_id, original_text, mask, ord). The mask of the last entity with a text, at
    the place of the first; ``ord`` numbers a document's values from 1."""
    at = F.struct(*ORDER)
    rows = entities.groupBy("doc_id", "original_text").agg(F.max_by("masked_text", at).alias("mask"), F.min(at).alias("first"))
    return numbered(rows, "first")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``ord`` from 1 by a column, inside each document."""
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(by, "original_text", "mask"))).alias("d"))
    return listed.select("doc_id", F.posexplode("d").alias("ord", "x")).select("doc_id", "x.original_text", "x.mask", (F.col("ord") + 1).cast("long").alias("ord"))


def initial_items(entities: DataFrame) -> DataFrame:
    """R2: (doc_id, items): text, type, mask, confidence of every span, in order."""
    item = F.struct(*ORDER, F.col("original_text").alias("text"), F.col("entity_type").alias("type"), F.col("masked_text").alias("mask"), "confidence")
    rows = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    names = ("text", "type", "mask", "confidence")
    return rows.select("doc_id", F.transform("items", lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("items"))


def final_items(replacements: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, ord, text, type, mask, type_conflict). The type of the first span
    with the text, else USER_ADDED; a conflict if the mask names another type."""
    kinds = entities.groupBy("doc_id", "original_text").agg(F.min_by("entity_type", F.struct(*ORDER)).alias("kind"))
    rows = replacements.join(kinds, ["doc_id", "original_text"], "left")
    kind = F.coalesce("kind", F.lit("USER_ADDED"))
    conflict = F.col("kind").isNotNull() & (F.col("mask") != F.concat(F.lit("["), "kind", F.lit("_REDACTED]")))
    return rows.select("doc_id", "ord", F.col("original_text").alias("text"), kind.alias("type"), "mask", conflict.alias("type_conflict"))


def merge_clarifications(replacements: DataFrame, pairs: DataFrame) -> DataFrame:
    """The dictionary after ``pairs(doc_id, question_no, pair_no, original_text, mask)``:
    known values get the new mask and keep their place, new ones follow."""
    old = replacements.select("doc_id", "original_text", "mask", F.struct(F.lit(0).alias("q"), F.col("ord").cast("long").alias("n")).alias("at"))
    new = pairs.select("doc_id", "original_text", "mask", F.struct(F.col("question_no").cast("int").alias("q"), F.col("pair_no").cast("long").alias("n")).alias("at"))
    rows = old.unionByName(new).groupBy("doc_id", "original_text").agg(F.max_by("mask", "at").alias("mask"), F.min("at").alias("first"))
    return numbered(rows, "first")


def validation_status(parsed: DataFrame) -> DataFrame:
    """(doc_id, outcome): ``unparsed`` and ``complete`` keep the dictionary, ``ask``
    has questions, ``nothing`` has none."""
    outcome = F.when(~F.col("parsed"), "unparsed").when(F.coalesce(F.col("status") == "COMPLETE", F.lit(False)), "complete").when(F.size("questions") > 0, "ask").otherwise("nothing")
    return parsed.select("doc_id", outcome.alias("outcome"))


def coverage_gaps(entities: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected values of a type the document's entities have, whose span none of them has."""
    types = entities.select("doc_id", "entity_type").distinct()
    covered = entities.select("doc_id", "start_pos", "end_pos")
    rows = detected.join(types, ["doc_id", "entity_type"], "left_semi").join(covered, ["doc_id", "start_pos", "end_pos"], "left_anti")
    return rows.select("doc_id", "original_text", "entity_type", "start_pos", "end_pos")


def party_completeness(entities: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(doc_id, has_buyer, has_supplier, status): one party without the other, or a gap,
    asks for clarification."""
    rows = entities.groupBy("doc_id").agg(F.bool_or(F.col("entity_type") == "BUYER").alias("has_buyer"), F.bool_or(F.col("entity_type") == "SUPPLIER").alias("has_supplier"))
    missing = F.col("has_buyer") != F.col("has_supplier")
    if gaps is not None:
        rows = rows.join(gaps.groupBy("doc_id").agg(F.count("*").alias("n_gaps")), "doc_id", "left")
        missing |= F.col("n_gaps").isNotNull()
    return rows.select("doc_id", "has_buyer", "has_supplier", F.when(missing, "NEEDS_CLARIFICATION").otherwise("COMPLETE").alias("status"))


def missing_candidates(parsed: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, original_text, entity_type, reason) that an answer names and the dictionary lacks."""
    rows = parsed.select("doc_id", F.explode("missing").alias("m")).select("doc_id", "m.*").filter("original_text is not null")
    return rows.join(replacements.select("doc_id", "original_text"), ["doc_id", "original_text"], "left_anti")
