"""Where the values stand in the documents.

Candidates meet their own document only (an equi-join on ``doc_id``), each distinct
value of a document once, before any pattern runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import Occurrences
from ..functions.text import NOT_WS, SPAN, WS, escape, once, py_strip, redacted, spans, token_pattern
from . import chunks as C
from . import responses as P
from .meeting import meet

NO_SPANS = f"array<{SPAN}>"

# fixed values: the id formats
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{2}-?[0-9]{2}",
    "SNILS": r"[0-9]{3}-[0-9]{3}-[0-9]{3} [0-9]{2}",
}
TOKEN = r"[\p{L}\p{N}]"
DIGITS = {9: "KPP", 10: "INN", 12: "INN", 13: "OGRN", 15: "OGRNIP"}
#: whole tokens of so many digits
DIGIT_TOKEN = f"(?<!{TOKEN})(?:" + "|".join(f"[0-9]{{{n}}}" for n in DIGITS) + f")(?!{TOKEN})"


def find_occurrences(needle: Column, text: Column) -> Column:
    """L1: spans of exact matches and, for needles of two tokens or more, of matches in
    any case with any white space between tokens; distinct, by start."""
    exact = F.when(F.contains(text, needle), spans(text, escape(needle))).otherwise(F.array().cast(NO_SPANS))
    several = py_strip(needle).rlike(WS)
    first = F.regexp_extract(py_strip(needle), f"^{NOT_WS}+", 0)
    flexible = F.when(several & F.contains(F.lower(text), F.lower(first)), spans(text, token_pattern(needle))).otherwise(F.array().cast(NO_SPANS))
    return F.array_sort(F.array_union(exact, flexible))


CANDIDATE = ["chunk_no", "resp_no", "cand_no", "entity_type", "confidence"]


def locate_entities(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """L2: (doc_id, chunk_no, resp_no, cand_no, hit_no, original_text, masked_text, start_pos, end_pos,
    entity_type, confidence) of each candidate's places in its whole document. A document's candidates are
    one automaton, and its text is walked once for all of them (``meeting``)."""
    first = candidates.groupBy("doc_id", "candidate").agg(F.min(F.struct(*CANDIDATE)).alias("c")).select("doc_id", "candidate", "c.*")
    places = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
    hit = T.StructType([*[first.schema[c] for c in CANDIDATE], T.StructField("hit_no", T.IntegerType()), T.StructField("s", places)])

    def make(entries: list[dict]) -> tuple:
        return entries, Occurrences([e["candidate"] for e in entries])

    def use(held: tuple, given: str | None) -> list[tuple]:
        entries, text = held[0], given or ""
        return [
            (*[entries[i][c] for c in CANDIDATE], n, {"start": a, "end": b, "text": text[a:b]})
            for i, found in held[1].hits(text).items() for n, (a, b) in enumerate(found)
        ]

    rows = meet(docs.select("doc_id", "text"), first, make, use, ["text"], hit, keep=["doc_id"], left=False)
    return rows.select(
        "doc_id", "chunk_no", "resp_no", "cand_no", "hit_no", F.col("s.text").alias("original_text"), redacted(F.col("entity_type")).alias("masked_text"),
        F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), "entity_type", "confidence",
    )


def dedup_spans(found: DataFrame) -> DataFrame:
    """L3: one row for each (doc_id, start_pos, end_pos), the first in chunk, answer and
    candidate order. ``min`` over a struct combines before the shuffle; no sort."""
    rest = [c for c in found.columns if c not in ("doc_id", "start_pos", "end_pos", "chunk_no", "resp_no", "cand_no", "hit_no")]
    order = F.struct("chunk_no", "resp_no", "cand_no", "hit_no", *rest)
    return found.groupBy("doc_id", "start_pos", "end_pos").agg(F.min(order).alias("m")).select(
        "doc_id", "m.chunk_no", "m.resp_no", "m.cand_no", "m.original_text", "m.masked_text", "start_pos", "end_pos", "m.entity_type", "m.confidence"
    )


def detect_structured(docs: DataFrame, text: str = "text") -> DataFrame:
    """L4: entities by pattern (EMAIL, PHONE, SNILS) and digit tokens by length (KPP, INN, OGRN, OGRNIP)."""
    docs, c = docs.select("doc_id", F.col(text).alias("text")), F.col("text")
    # a cheap test first: most texts have none of the signs a pattern needs
    signs = {"EMAIL": F.contains(c, F.lit("@")), "PHONE": F.contains(c, F.lit("+")), "SNILS": c.rlike("[0-9]-[0-9]{3} ")}
    none = F.array().cast(NO_SPANS)

    def named(kind: Column):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), kind.alias("type"))

    typed = [F.transform(F.when(signs[kind], spans(c, F.lit(p))).otherwise(none), named(F.lit(kind))) for kind, p in PATTERNS.items()]
    kinds = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    digits = F.when(c.rlike("[0-9]{9}"), spans(c, F.lit(DIGIT_TOKEN))).otherwise(none)
    typed.append(F.transform(digits, lambda s: named(kinds[s["end"] - s["start"]])(s)))
    # found once: the planner would compute an explosion's expression a second time, as a filter on its size
    rows = once(docs, _found=F.concat(*typed)).select("doc_id", F.explode("_found").alias("s"))
    return rows.select(
        "doc_id", F.col("s.text").alias("original_text"), redacted(F.col("s.type")).alias("masked_text"),
        F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.type").alias("entity_type"), F.lit(1.0).alias("confidence"),
        F.lit(0).alias("chunk_no"), F.lit(0).alias("resp_no"), F.lit(0).alias("cand_no"),
    )


def first_named(named: DataFrame, detected: DataFrame) -> DataFrame:
    """``named`` and what ``detected`` has at other places. Both are read once: an anti-join would locate all values a second time."""
    every = named.withColumn("_from", F.lit(0)).unionByName(detected.withColumn("_from", F.lit(1)))
    first = F.min("_from").over(Window.partitionBy("doc_id", "start_pos", "end_pos"))
    return every.withColumn("_first", first).filter("_from = _first").drop("_from", "_first")


def select_target_types(entities: DataFrame, types: list[str]) -> DataFrame:
    """Only the types asked for."""
    return entities.filter(F.col("entity_type").isin(list(types)))


def extract_entities(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Entities of all documents from the answers to their chunks."""
    filled = docs.filter(F.col("text").rlike(NOT_WS))
    candidates = P.entity_candidates(P.explode_entities(P.parse_responses(responses)))
    return dedup_spans(locate_entities(candidates, filled))


def requests(docs: DataFrame, types: list[str] = C.DEFAULT_TYPES, size: int = 6000, overlap: int = 400) -> DataFrame:
    """The request table for plain documents."""
    filled = docs.filter(F.col("text").rlike(NOT_WS))
    return C.extraction_requests(C.filter_short_chunks(C.chunk_sliding(filled, size, overlap)), types)
