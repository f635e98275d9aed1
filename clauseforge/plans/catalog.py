"""All queries of the engine by name, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """The queries and oracles, with every module that registers some imported."""
    from clauseforge.plans import change_queries, diff_queries, element_queries, function_queries, record_queries, relation_queries, sequence_queries, shape_queries, table_queries, text_queries  # noqa: F401

    return QUERIES, ORACLES
