"""All queries: name, function and SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyfold.queries import core, extensions, files, graphs, learning, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (texts, graphs, learning, core, files, extensions):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
