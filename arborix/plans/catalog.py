"""Registry of the engine's queries over the driver tables and of the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_queries, evaluation_queries, graph_queries, sample_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (graph_queries, context_queries, evaluation_queries, sample_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: gated extraction from all regions."""
    return graph_queries.QUERIES["gated_extraction"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
