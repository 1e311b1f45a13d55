"""Macros: SQL functions, and vectorized Python functions under a SQL name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from metricspark.defs import MacroDef

_AS_TABLE = re.compile(r"\)\s*as\s+table\b", re.IGNORECASE)
_AS = re.compile(r"\)\s*as\b", re.IGNORECASE)
_RETURNS = re.compile(r"\)\s*returns?\b", re.IGNORECASE)


def macro_sql(macro: MacroDef) -> str:
    """`f(x int) return x + 1`, or the same with `as` for `return`. Parameters need types."""
    text = macro.sql.strip()
    if not _RETURNS.search(text):
        text, tables = _AS_TABLE.subn(") returns table return", text, count=1)
        if not tables:
            text = _AS.sub(") return", text, count=1)
    return f"create or replace temporary function {text}"


def register_macros(spark: SparkSession, macros: Iterable[MacroDef]) -> None:
    for macro in macros:
        spark.sql(macro_sql(macro))


def register_python_macro(spark: SparkSession, name: str, fn: Callable, return_type: str) -> None:
    """A function over pandas Series, called from SQL by name; rows travel in Arrow batches.

    For what built-in functions cannot express: an expression of built-in functions needs no
    Python worker and lets filters reach the scan.
    """
    spark.udf.register(name, F.pandas_udf(fn, return_type))
