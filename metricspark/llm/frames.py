"""Frames kept in the shared folder, and connected components over frames of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.session import new_work_path


def stage(df: DataFrame, purpose: str, *partitions: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps start from the written table.

    A lost executor cannot take it, lineage ends here, and its size is known to the planner.
    """
    path = new_work_path(df.sparkSession, purpose)
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of fewer rows than Spark's default, unless the session says otherwise:
    ten thousand whole documents at a time are more than a small executor can hold beside its heap."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, as (start, length), whose texts hold about `size` bytes, or one row."""
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield start, i - start
            start, total = i, 0
        total += n + 1
    if len(lengths):
        yield start, len(lengths) - start


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text column of each holds about `size` bytes, or one row."""
    for batch in batches:
        for start, length in spans(batch.column(column), size):
            yield batch.slice(start, length)


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """The smallest node each node of `links` can reach, as (node, component).

    Rounds of large and small stars: every node's larger neighbours are hung on its smallest one,
    then its smaller neighbours are. Both keep components whole, and the links end as stars around
    the smallest nodes after a number of rounds that grows with the logarithm of the longest path.
    Neighbours are only ever folded to a minimum and joined back, never listed, so a node with very
    many links is no large group. Every round is written to the shared folder.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = stage(_downwards(links), "components")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select("v", "m")).distinct()
        small = stage(_downwards(small), "components")
        if small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty():
            root = small.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
        edges = small
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _downwards(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
