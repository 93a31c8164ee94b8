"""Chunks of documents and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_WS, collapse_whitespace, once, py_strip
from ..schemas import DEFAULT_TYPES
from .assemble import PAGE, around


def sliding_starts(length: Column, size: int, overlap: int) -> Column:
    step = max(1, size - overlap)
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length - 1, F.lit(step)))


def chunk_sliding(docs: DataFrame, size: int = 6000, overlap: int = 400, text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk): a text of at most ``size`` characters whole, else
    windows until its end; the last may lie inside the one before. Null and empty texts give none."""
    starts = sliding_starts(F.length(text), size, overlap)
    rows = docs.filter(F.length(text) > 0).select("doc_id", text, F.posexplode(starts).alias("chunk_no", "start"))
    return rows.select("doc_id", "chunk_no", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def chunk_by_page(pages: DataFrame, size: int = 6000, overlap: int = 400) -> DataFrame:
    """(doc_id, chunk_no, chunk) from ``pages(doc_id, page_no, name, text)``: documents
    of two pages or more give a chunk ``[name]`` + text for each page that isn't blank,
    others are cut by :func:`chunk_sliding` from their full text, which begins with the page's heading."""
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    rows = pages.join(counted, "doc_id")
    several = rows.filter((F.col("n_pages") > 1) & F.col("text").rlike(NOT_WS)).select(
        "doc_id", F.col("page_no").alias("chunk_no"), F.concat(F.lit("["), "name", F.lit("]\n"), "text").alias("chunk")
    )
    full = F.concat(around(PAGE, F.col("page_no")), F.coalesce("text", F.lit("")))
    one = chunk_sliding(rows.filter("n_pages = 1").withColumn("text", full), size, overlap)
    return several.unionByName(one)


def filter_short_chunks(chunks: DataFrame, least: int = 20) -> DataFrame:
    """Chunks with white space collapsed; those under ``least`` characters go (the page's
    name counts)."""
    # made once: the filter on its length would be moved below and make it a second time
    rows = once(chunks, _short=collapse_whitespace(F.col("chunk")))
    return rows.withColumn("chunk", F.col("_short")).drop("_short").filter(F.length("chunk") >= least)


def resolve_target_types(jobs: DataFrame) -> DataFrame:
    """(job_id, types) from ``jobs(job_id, ticked array<string>, custom string)``: the
    ticked types, then the custom ones split at ``, ;`` and line ends, each spelling of a
    name only once, the first one."""
    custom = F.transform(F.split("custom", "[,;\\n]", -1), py_strip)
    custom = F.filter(F.coalesce(custom, F.array().cast("array<string>")), lambda t: F.length(t) > 0)
    every = F.concat(F.coalesce("ticked", F.array().cast("array<string>")), custom)
    rows = jobs.select("job_id", F.posexplode_outer(every).alias("at", "type"))
    first = rows.groupBy("job_id", F.lower("type").alias("key")).agg(F.min(F.struct("at", "type")).alias("t"))
    kept = first.groupBy("job_id").agg(F.array_sort(F.collect_list(F.when(F.col("t.type").isNotNull(), F.col("t")))).alias("t"))
    return kept.select("job_id", F.col("t.type").alias("types"))


EXTRACTION = """TASK: find every value of the types {types} in the text below and return it as it stands there,
without labels before it. Quotation marks inside a value are escaped as \\". Formats: INN 10 or 12 digits, KPP 9,
OGRN 13, OGRNIP 15; PHONE in any form; EMAIL the address alone; parties as SUPPLIER or BUYER, else PARTY.
ANSWER: one JSON object and nothing else:
{"target_types_received": [...], "entities": [{"original_text": "...", "entity_type": "...", "confidence": 0.95}]}
TEXT:
---
{text}
---"""

VALIDATION = """TASK: check whether values are missing, for the types already found only, and whether both parties are
named if one is. ANSWER: one JSON object {"status": "COMPLETE" or "NEEDS_CLARIFICATION", "questions": [...],
"missing_entities_candidates": [{"original_text": "...", "entity_type": "...", "reason": "..."}]}.
FOUND:
{found}
TEXT:
---
{text}
---"""

CLARIFICATION = """TASK: turn the answer into pairs for the dictionary of values and masks.
QUESTION: {question}
REPLY: {reply}
ANSWER: one JSON object {"value": "[TYPE_REDACTED]"} and nothing else."""


def fill(template: str, **columns: Column) -> Column:
    """The template with columns in place of its ``{name}`` marks."""
    parts, rest = [], template
    while marks := [(rest.find("{" + k + "}"), k) for k in columns if "{" + k + "}" in rest]:
        at, name = min(marks)
        parts += [F.lit(rest[:at]), columns[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


def extraction_requests(chunks: DataFrame, types=DEFAULT_TYPES) -> DataFrame:
    """(doc_id, chunk_no, prompt): one request for each chunk."""
    return chunks.select("doc_id", "chunk_no", fill(EXTRACTION, types=F.lit(", ".join(types)), text=F.col("chunk")).alias("prompt"))


def validation_requests(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, prompt): one request for each document, its dictionary as JSON, a null one as {}."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "original_text", "mask"))), lambda x: F.struct(x["original_text"].alias("key"), x["mask"].alias("value")))
    found = replacements.groupBy("doc_id").agg(F.to_json(F.map_from_entries(pairs)).alias("found"))
    rows = docs.select("doc_id", "text").join(found, "doc_id", "left")
    return rows.select("doc_id", fill(VALIDATION, found=F.coalesce("found", F.lit("{}")), text=F.coalesce("text", F.lit(""))).alias("prompt"))


def clarification_requests(validations: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, question_no, prompt) for every answered question; blank answers skip theirs.
    ``validations(doc_id, questions array<string>)``, ``answers(doc_id, question_no, answer)``."""
    asked = validations.select("doc_id", F.posexplode("questions").alias("question_no", "question"))
    asked = asked.withColumn("question_no", F.col("question_no") + 1)
    said = answers.select("doc_id", "question_no", py_strip(F.col("answer")).alias("reply")).filter("length(reply) > 0")
    rows = asked.join(said, ["doc_id", "question_no"])
    return rows.select("doc_id", "question_no", fill(CLARIFICATION, question=F.col("question"), reply=F.col("reply")).alias("prompt"))
