"""Masking of segments, runs and cells.

A document's dictionary is one automaton, which its segments pass one after the other (``meeting``): a segment
is walked once, whatever the dictionary's size. Inside a segment all values' matches are pooled and the leftmost,
then longest, kept. A document with very many segments is a hot key: ``salt`` spreads its segments over that many tasks
and repeats its dictionary for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import Flexible, leftmost_longest
from ..functions.text import NOT_WS
from .meeting import meet

KEPT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("mask", T.StringType())]))
PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("is_mask", T.BooleanType())]))


def rank_replacements(replacements: DataFrame) -> DataFrame:
    """M1: (doc_id, original_text, mask, rank) without blank values; the longest first, ties in dictionary order."""
    rows = replacements.filter(F.col("original_text").rlike(NOT_WS))
    by = Window.partitionBy("doc_id").orderBy(F.length("original_text").desc(), "ord")
    return rows.select("doc_id", "original_text", "mask", F.row_number().over(by).alias("rank"))


class Masks:
    """A document's ranked values and their masks."""

    def __init__(self, entries: list[dict]):
        self.masks = [e["mask"] for e in entries]
        self.values = Flexible([e["original_text"] for e in entries])

    def kept(self, text: str) -> list[dict]:
        """M3: the spans of a segment that are masked; values are numbered by rank."""
        return [{"start": a, "end": b, "mask": self.masks[i]} for a, b, i in leftmost_longest(self.values.hits(text))]


def pieces_of(text: str, kept: list[dict]) -> list[str]:
    """Plain and mask pieces by turns, empty ones too."""
    pieces, at = [], 0
    for s in kept:
        pieces += [text[at : s["start"]], s["mask"]]
        at = s["end"]
    return [*pieces, text[at:]]


def fragments(text: str, kept: list[dict]) -> list[dict]:
    """M6: plain and mask pieces in order, no empty ones."""
    return [{"text": t, "is_mask": i % 2 == 1} for i, t in enumerate(pieces_of(text, kept)) if t]


def _masked(text: str | None, kept: list[dict]) -> tuple:
    """The values of ``MASKED``."""
    if not kept:
        return [], None, text
    pieces = fragments(text, kept)
    return kept, pieces, "".join(x["text"] for x in pieces)


MASKED = T.StructType([T.StructField("spans", KEPT), T.StructField("fragments", PIECES), T.StructField("masked", T.StringType())])


def _ranked(replacements: DataFrame) -> DataFrame:
    return rank_replacements(replacements).select("doc_id", "rank", "original_text", F.coalesce("mask", F.lit("")).alias("mask"))


def mask_segments(segments: DataFrame, replacements: DataFrame, text: str = "text", salt: int = 1) -> DataFrame:
    """M4: ``segments`` with ``spans``, ``fragments`` and ``masked``. Matches don't cross segments; null texts stay null."""

    def use(held: Masks | None, given: str | None) -> list[tuple]:
        return [_masked(given, held.kept(given) if held and given else [])]

    return meet(segments, _ranked(replacements), Masks, use, [text], MASKED, salt=salt)


def residual_hits(masked: DataFrame, replacements: DataFrame, text: str = "masked") -> DataFrame:
    """(doc_id, residual_hits): dictionary matches that are left in the masked texts."""
    rows = mask_segments(masked.select("doc_id", text), replacements, text).select("doc_id", F.size("spans").alias("n"))
    return rows.groupBy("doc_id").agg(F.sum("n").cast("long").alias("residual_hits"))


def spread_over_runs(runs: list[dict], kept: list[dict]) -> list[list[dict]]:
    """Each run's own spans: ordered runs and ordered spans in one sweep. The first run that a span overlaps takes its mask, the
    others lose their part; a span that touches a complex run, an empty one inside it too, is skipped."""
    starts, ends, at = [], [], 0
    for r in runs:
        starts.append(at)
        at += len(r["text"])
        ends.append(at)
    own: list[list[dict]] = [[] for _ in runs]
    i = 0
    for s in kept:
        while ends[i] <= s["start"]:
            i += 1
        last = i
        while ends[last] < s["end"]:
            last += 1
        touched = [j for j in range(i, last + 1) if starts[j] < s["end"] and ends[j] > s["start"]]
        if not any(runs[j]["is_complex"] for j in touched):
            for j in touched:
                own[j].append({"start": max(s["start"], starts[j]) - starts[j], "end": min(s["end"], ends[j]) - starts[j], "mask": s["mask"] if j == touched[0] else ""})
    return own


def mask_runs(runs: DataFrame, replacements: DataFrame) -> DataFrame:
    """M5: ``runs(doc_id, para_no, run_no, text, is_complex)`` with ``spans``, ``fragments`` and ``masked``. Spans found in the
    paragraph's joined text are spread over the runs they overlap; see ``spread_over_runs``. All columns but
    the last three tell paragraphs apart (``part`` of a file, say)."""
    item = F.struct("run_no", F.coalesce("text", F.lit("")).alias("text"), "is_complex")
    key = [c for c in runs.columns if c not in ("run_no", "text", "is_complex")]
    listed = runs.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("runs"))
    add = T.StructType([T.StructField("run_no", runs.schema["run_no"].dataType), T.StructField("text", T.StringType()), T.StructField("is_complex", T.BooleanType()), *MASKED.fields])

    def use(held: Masks | None, listed: list[dict]) -> list[tuple]:
        kept = held.kept("".join(r["text"] for r in listed)) if held else []
        return [(r["run_no"], r["text"], r["is_complex"], *_masked(r["text"], own)) for r, own in zip(listed, spread_over_runs(listed, kept), strict=True)]

    rows = meet(listed, _ranked(replacements), Masks, use, ["runs"], add, keep=key)
    return rows.select(*key, "run_no", "text", "is_complex", "spans", "fragments", "masked")


def mask_cells(cells: DataFrame, replacements: DataFrame, salt: int = 1, spans: bool = True) -> DataFrame:
    """M7: ``cells`` with ``spans``, ``fragments``, ``masked`` and ``modified``. Null cells
    and formulas (flagged, or starting with ``=``) stay as they are. spans: with ``spans`` and ``fragments``, which cost as
    much as the masking, and which a later ``select`` can't save."""

    def use(held: Masks | None, value: str | None, is_formula: bool | None) -> list[tuple]:
        kept = held.kept(value) if held and value and not is_formula and value[0] != "=" else []
        if spans:
            return [(*_masked(value, kept), bool(kept))]
        return [("".join(pieces_of(value, kept)), True)] if kept else [(value, False)]

    add = T.StructType([*(MASKED.fields if spans else [MASKED["masked"]]), T.StructField("modified", T.BooleanType())])
    return meet(cells, _ranked(replacements), Masks, use, ["value", "is_formula"], add, salt=salt)


def changed_cells(cells: DataFrame, replacements: DataFrame, salt: int = 1) -> DataFrame:
    """M7: of ``cells`` those that get a mask, with all columns but ``value`` and ``is_formula``, and ``fragments``."""

    def use(held: Masks, value: str) -> list[tuple]:
        kept = held.kept(value)
        return [(fragments(value, kept),)] if kept else []

    texts = cells.filter("length(value) > 0 and not startswith(value, '=') and not coalesce(is_formula, false)").drop("is_formula")
    return meet(texts, _ranked(replacements), Masks, use, ["value"], T.StructType([MASKED["fragments"]]), keep=[c for c in texts.columns if c != "value"], salt=salt, left=False)


def cell_stats(masked: DataFrame) -> DataFrame:
    """M8: (doc_id, n_fragments, n_cells) replaced."""
    return masked.groupBy("doc_id").agg(F.sum(F.size("spans")).cast("long").alias("n_fragments"), F.sum(F.col("modified").cast("long")).alias("n_cells"))


def mask_by_format(cells: DataFrame, runs: DataFrame, words: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, file_type, seg_no, masked) of a corpus of all formats: docx paragraphs from their
    runs (M5), xlsx cells in sheet order (M7), pdf pages from their positioned words (M9 to M12)."""
    from .pages import match_boxes, redact_pages  # which takes this module's ranks

    columns = ["doc_id", "file_type", "seg_no", "masked"]
    paragraphs = mask_runs(runs, replacements).groupBy("doc_id", F.col("para_no").alias("seg_no")).agg(F.array_sort(F.collect_list(F.struct("run_no", "masked"))).alias("r"))
    docx = paragraphs.withColumn("masked", F.array_join("r.masked", "")).withColumn("file_type", F.lit("docx")).select(*columns)
    order = Window.partitionBy("doc_id").orderBy("sheet", "row_no", "col_no")
    xlsx = mask_cells(cells, replacements, spans=False).withColumn("file_type", F.lit("xlsx")).withColumn("seg_no", F.row_number().over(order)).select(*columns)
    pdf = redact_pages(words, match_boxes(words, replacements)).withColumn("file_type", F.lit("pdf")).withColumnRenamed("page_no", "seg_no").select(*columns)
    return docx.unionByName(xlsx).unionByName(pdf)
