"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_docs, catalog_mask, catalog_office, catalog_text

CATALOGS = [catalog_text, catalog_mask, catalog_docs, catalog_office]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for c in CATALOGS for k, f in c.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in CATALOGS for k, s in c.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_docs.w1_lang(spark, sf_dir)
