"""Database tables, read over several connections when a split column is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from metricspark.defs import SourceDef

SPLIT_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def jdbc_options(d: SourceDef) -> dict[str, str]:
    """Options of the JDBC reader. `source` is the table, or a query in parentheses with an alias."""
    options = {k: str(v) for k, v in d.options.items()}
    if "url" not in options:
        raise ValueError(f"source {d.name}: a jdbc source needs the option 'url'")
    given = [k for k in SPLIT_OPTIONS if k in options]
    if "partitionColumn" not in options and options.pop("singleConnection", "false").lower() != "true":
        raise ValueError(
            f"source {d.name}: without {', '.join(SPLIT_OPTIONS)} one task reads the whole table; "
            "for a small one say singleConnection: true"
        )
    if given and len(given) < len(SPLIT_OPTIONS):
        missing = sorted(set(SPLIT_OPTIONS) - set(given))
        raise ValueError(f"source {d.name}: a split read also needs {', '.join(missing)}")
    return {"dbtable": d.source, "fetchsize": "10000", **options}


def jdbc_reader(spark: SparkSession, d: SourceDef) -> DataFrameReader:
    reader = spark.read.format("jdbc").options(**jdbc_options(d))
    return reader.option("customSchema", d.schema) if d.schema else reader


def read_jdbc(spark: SparkSession, d: SourceDef) -> DataFrame:
    return jdbc_reader(spark, d).load()
