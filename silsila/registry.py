"""All queries of the engine and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import corpus_queries, literal_queries, small_corpus  # noqa: F401  small_corpus adds to the queries of corpus_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus_queries.QUERIES | literal_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus_queries.ORACLES | literal_queries.ORACLES
