"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as Q
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: fn for name, fn in vars(Q).items() if name.startswith("op") and callable(fn)}
ORACLE_SQL: dict[str, str] = {name: text for name, text in vars(sql).items() if name.startswith("op")}
