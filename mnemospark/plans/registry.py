"""Queries of the core operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.plans import corpus, facade, fuller, graphs, layers, lifecycle, pipelines, rebuild, recall, texts, timeline, upkeep, vectors

_CATALOGUES = [c.CATALOGUE for c in (lifecycle, graphs, texts, vectors, timeline, pipelines, upkeep, layers, recall, rebuild, facade, fuller)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = corpus.queries()
    for c in _CATALOGUES:
        out |= c.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = corpus.oracle_sql()
    for c in _CATALOGUES:
        out |= c.sql
    return out


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search over the documents."""
    return texts.bm25_search(spark, folder)
