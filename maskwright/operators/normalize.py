"""N1 to N8 on a text column of a table. No shuffle: one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STEPS = {
    "strip_zero_width": T.strip_zero_width, "ascii_typography": T.ascii_typography, "join_hyphenated": T.join_hyphenated,
    "merge_wrapped_lines": T.merge_wrapped_lines, "fix_letter_spacing": T.fix_letter_spacing, "tidy_spaces": T.tidy_spaces,
    "normalize_text": T.normalize_text, "collapse_whitespace": T.collapse_whitespace,
}


def apply(df: DataFrame, step: str, text: str = "text") -> DataFrame:
    return df.withColumn(text, STEPS[step](F.col(text)))


def normalize(df: DataFrame, text: str = "text") -> DataFrame:
    return apply(df, "normalize_text", text)
