"""Folders of files as streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from metricspark.defs import SourceDef

FORMATS = ("parquet", "csv", "json")


def read_stream(spark: SparkSession, d: SourceDef, max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder, as they arrive. The schema must be given, as streams infer none."""
    kind = d.type.lower()
    if kind not in FORMATS:
        raise ValueError(f"source {d.name}: cannot stream type {d.type!r}")
    if not d.schema:
        raise ValueError(f"source {d.name}: a stream needs a schema")
    reader = spark.readStream.schema(d.schema).options(**d.options)
    if kind == "csv":
        reader = reader.option("header", d.options.get("header", True))
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    path = d.source
    if os.path.isfile(path):
        # a stream watches folders; a single local file is the one match in its folder
        path, name = os.path.split(path)
        reader = reader.option("pathGlobFilter", name)
    return reader.format(kind).load(path)
