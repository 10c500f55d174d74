"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import registry
from .plans import sectors, indicators, screens, backtests, fundamentals, model, tables  # noqa: F401, I001  each registers its queries; sectors first, as the screens' SQL uses its blocks


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
