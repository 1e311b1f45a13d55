"""Metrics over a growing folder of files, refreshed by reading new files only.

A refresh lists the files, reads those that the manifest does not name, and merges the folds' states of their rows into
the stored ones, one per series. Where a file has gone or has another size or time than the manifest says, what was counted
cannot be taken back, and all files are read again. Manifest and states of a refresh are published together: a refresh
that fails, or a driver that ends, leaves the last one whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.defs import MetricDef, SourceDef
from metricspark.operators.samples import Rows, to_rows
from metricspark.operators.states import make_states, merge_states, state_samples
from metricspark.publish import PublishedTable
from metricspark.session import settle
from metricspark.sources.read import FILES, read_files, sql

SAME = ("path", "length", "modified")


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the files it read, and whether it read all anew."""

    read: tuple[str, ...]
    anew: bool


class IncrementalMetrics:
    """Metrics of one query over the rows of a source's files, with their states below `path`."""

    def __init__(
        self, spark: SparkSession, source: SourceDef, query: str, metrics: Sequence[tuple[MetricDef, str]], path: str
    ) -> None:
        if source.type.lower() not in FILES or not source.schema:
            raise ValueError(f"source {source.name}: files of a type in {', '.join(FILES)} and a schema are needed")
        if len({m.order_by for m, _ in metrics}) != 1:
            raise ValueError("metrics folded together must name the same order column")
        self.spark, self.source, self.query = spark, source, query
        # quantiles of states are always sketched
        self.metrics = [(replace(m, quantiles="sketch"), name) for m, name in metrics]
        self.published = PublishedTable(spark, path)

    def _rows(self, files: Sequence[str]) -> Rows:
        """The query's rows over some files."""
        if files:
            frame = read_files(self.spark, self.source, [_escaped(f) for f in files])
        else:
            frame = self.spark.createDataFrame([], self.source.schema)
        frame.createOrReplaceTempView(self.source.name)
        return to_rows(sql(self.spark, self.query), self.metrics[0][0].order_by)

    def refresh(self) -> Refreshed:
        # the files as they are now; their contents are not read
        files = self.spark.read.format("binaryFile").load(self.source.source)
        listed = settle(files.select("path", "length", F.col("modificationTime").alias("modified")))
        known = self._known("files", listed)
        anew = known is None or not known.join(listed, list(SAME), "left_anti").isEmpty()
        new = listed if anew else listed.join(known, list(SAME), "left_anti")
        # a row per new file: they have to be named to be read
        paths = tuple(sorted(r.path for r in new.select("path").collect()))
        if not paths and not anew:
            return Refreshed((), False)
        rows = self._rows(paths)
        states = make_states(rows, self.metrics)
        old = None if anew else self._known("states", states)
        if old is not None:
            states = merge_states(old.select(states.columns).union(states), rows.keys, self.metrics).select(states.columns)

        def write(folder: str) -> None:
            listed.write.parquet(f"{folder}/files")
            states.write.parquet(f"{folder}/states")

        self.published.publish(write)
        return Refreshed(paths, anew)

    def _known(self, part: str, like: DataFrame) -> DataFrame | None:
        if not self.published.versions():
            return None
        return self.spark.read.schema(like.schema).parquet(f"{self.published.folder}/{part}")

    def samples(self, global_labels: Mapping[str, str] | None = None) -> DataFrame:
        """The metrics over all files that the last refresh knew."""
        rows = self._rows(())
        none = make_states(rows, self.metrics)
        states = self._known("states", none)
        return state_samples(none if states is None else states, rows, self.metrics, global_labels)


def _escaped(path: str) -> str:
    """A path that is not read as a pattern."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)
