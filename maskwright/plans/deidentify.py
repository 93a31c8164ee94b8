"""A corpus de-identified from end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary as R
from ..operators import locate as L
from ..operators import mask as M
from ..operators import normalize as N
from ..operators import reports as H


@dataclass
class Result:
    """Tables of a run; write those you need, the others cost nothing."""

    masked: DataFrame
    entities: DataFrame
    replacements: DataFrame
    final_items: DataFrame
    gaps: DataFrame
    status: DataFrame
    json_reports: DataFrame
    txt_reports: DataFrame


def deidentify(
    docs: DataFrame, responses: DataFrame | None = None, clarifications: DataFrame | None = None, types: list[str] | None = None,
    normalize: bool = False, timestamp: str = "1970-01-01T00:00:00", salt: int = 4,
) -> Result:
    """``docs(doc_id, text)`` masked by the values that the detector finds and, if
    there are any, the model's answers name; of a place that both name the answer counts. Gaps are
    what the detector finds and the answers don't. ``clarifications`` are P11's pairs."""
    docs = N.normalize(docs) if normalize else docs
    detected = L.detect_structured(docs)
    named = L.extract_entities(docs, responses) if responses is not None else detected
    if types is not None:
        named, detected = L.select_target_types(named, types), L.select_target_types(detected, types)
    gaps = R.coverage_gaps(named, detected)
    entities = named
    if responses is not None:
        entities = L.first_named(named, detected)
    replacements = R.build_replacements(entities)
    if clarifications is not None:
        replacements = R.merge_clarifications(replacements, clarifications)
    final = R.final_items(replacements, entities)
    files = docs.select("doc_id", F.col("doc_id").cast("string").alias("source_file"), F.concat(F.col("doc_id").cast("string"), F.lit("_masked")).alias("masked_file"))
    items = H.report_items(R.initial_items(entities), final)
    return Result(
        masked=M.mask_segments(docs, replacements, salt=salt), entities=entities, replacements=replacements, final_items=final, gaps=gaps,
        status=R.party_completeness(entities, gaps), json_reports=H.json_report(files, items, timestamp), txt_reports=H.txt_report(files, items, timestamp),
    )
