"""Enrichment before the folds: labels from other tables, rules, and JSON without a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_labels(facts: DataFrame, dimension: DataFrame, on: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Left join of label columns; facts without a match keep their row and get the label NULL.

    Whether the dimension is sent to every task is left to Spark, which knows its size from the
    files or, after the first stages, from what was shuffled. A large one is joined by a shuffle,
    where adaptive execution splits the partitions of frequent keys.
    """
    return facts.join(dimension.select(*on, *labels), list(on), "left")


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first rule (pattern, class) that matches."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for pattern, name in rules], F.lit(default))


def json_schema(df: DataFrame, column: str) -> str:
    """The common schema of a JSON text column, inferred by one aggregation over all rows.

    Only the schema reaches the driver. Text that is not JSON does not take part.
    """
    variant = f"schema_of_variant_agg(try_parse_json({column}))"
    inferred = df.select(F.expr(variant)).first()[0]
    return (inferred or "VOID").replace("OBJECT<", "STRUCT<")


def schematize(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """Replace a JSON text column by typed columns, one per top level field."""
    schema = schema or json_schema(df, column)
    if not schema.startswith("STRUCT<"):
        raise ValueError(f"{column} holds no JSON objects with a common schema, but {schema}")
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return df.withColumn(column, parsed).select(*[c for c in df.columns if c != column], f"{column}.*")
