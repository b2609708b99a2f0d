"""Registry of the chunk-analytics queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return wrap


MODULES = ("q_profile", "q_chunks", "q_signals", "q_evaluate", "q_retrieval", "q_graph", "q_tune", "q_io", "q_reward")


def _load() -> None:
    """Imports the query modules, which register themselves."""
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest topic shifts between neighbouring windows, per language."""
    return queries()["topic_shifts"](spark, sf_dir)
