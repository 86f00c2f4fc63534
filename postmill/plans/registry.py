"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.plans import key_queries, more_queries, report_queries, state_queries, stream_queries, training_data

_MODULES = [training_data, key_queries, report_queries, more_queries, state_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
