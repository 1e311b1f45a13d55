"""Registered queries with their SQL twins.

A check is a query over the given tables and, where plain SQL can say the same, that SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.defs import Package
from metricspark.operators.folds import flat
from metricspark.operators.labels import canonical_map
from metricspark.operators.samples import extract
from metricspark.plans.package import PackageRun, run_package
from metricspark.session import prepare_session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# sums of doubles depend on the order they are added in
DIGITS = 4


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare_session(spark), sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", DIGITS))


def samples(run: PackageRun) -> DataFrame:
    if run.errors:
        raise RuntimeError(str(run.errors))
    return rounded(flat(run.samples))


def run_metrics(spark: SparkSession, metrics: dict, labels: dict | None = None, **package) -> DataFrame:
    """The samples of a package written as a dict."""
    p = Package.from_dict({"name": "shop", "metrics": metrics, **package})
    return samples(run_package(spark, p, labels))


def extracted(df: DataFrame) -> DataFrame:
    out = extract(df).select(canonical_map(F.col("labels")).alias("labels"), "value")
    return rounded(out)
