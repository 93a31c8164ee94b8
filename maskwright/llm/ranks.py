"""Ranks inside groups of any size, stored as the operators of this package store their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ranks
from .store import spread, written


def ranked(df: DataFrame, group: str, order: list[str], rank: str) -> DataFrame:
    """``df`` with ``rank``, 0, 1, 2 ... inside each ``group``; see ``operators.ranks``."""
    return ranks.ranked(df, group, order, rank, lambda rows: written(rows, "ranked"), spread(df))
