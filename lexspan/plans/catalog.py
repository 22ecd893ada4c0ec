"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cards, documents, govern, more, select, state, streams, text

_MODULES = (text, select, govern, documents, cards, more, state, streams)
FLAGSHIP = "hybrid_context"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
