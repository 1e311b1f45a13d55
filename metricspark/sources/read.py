"""One source definition to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from metricspark.defs import SourceDef
from metricspark.sources.jdbc import read_jdbc

FILES = ("parquet", "csv", "json")


def read_source(spark: SparkSession, d: SourceDef, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """Read by type; any other type is SQL, which sees the sources registered before it.

    CSV and JSON raise at damaged rows, and CSV at a header that contradicts the schema, unless the
    options `mode` and `enforceSchema` ask for Spark's lenient reading.
    Files take a path, a glob or any URI Spark has a file system for. Give CSV and JSON a
    `schema` where the data is large: inferring one reads the files once more.
    """
    kind = d.type.lower()
    if kind in FILES:
        return read_files(spark, d, d.source)
    if kind == "jdbc":
        return read_jdbc(spark, d)
    if kind == "arrow":
        from metricspark.sources.arrow import read_arrow  # needs pyarrow, which other sources do without

        return read_arrow(spark, d.source, d.schema)
    return sql(spark, d.source, variables)


def read_files(spark: SparkSession, d: SourceDef, paths: str | Sequence[str]) -> DataFrame:
    """The files of a source, or some of them."""
    kind = d.type.lower()
    reader = spark.read.format(kind).options(**d.options)
    if d.schema:
        reader = reader.schema(d.schema)
    if kind != "parquet":
        reader = reader.option("mode", d.options.get("mode", "FAILFAST"))
    if kind == "csv":
        reader = reader.option("header", d.options.get("header", True))
        reader = reader.option("enforceSchema", d.options.get("enforceSchema", False))
        if not d.schema:
            reader = reader.option("inferSchema", d.options.get("inferSchema", True))
    return reader.load(paths if isinstance(paths, str) else list(paths))


def sql(spark: SparkSession, text: str, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """SQL text with `:name` markers bound to the package's variables."""
    used = {k: v for k, v in (variables or {}).items() if f":{k}" in text}
    return spark.sql(text, args=used) if used else spark.sql(text)
