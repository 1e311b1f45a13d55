"""Counts per time window in which no row is lost: closed windows, late rows and open windows add up to all rows.

Spark's own windowed counts drop rows behind the watermark without a trace. Here each batch is split by the watermark
that the batches before it have set: rows whose window it has closed are counted apart, as late ones, others are added
to the open windows; windows that the new watermark closes are then written out. What is kept between batches - the open
windows and the newest time - is published under the batch's number, and so are its outputs: a batch that runs again
after a failure starts from the same state and replaces what it wrote.

Rows without a time are late ones of no window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricspark.publish import KEEP, PublishedTable

PARTS = ("closed", "late")


class WindowCounts:
    """A sink for `foreachBatch`: counts the rows of a stream per window and `by`."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        time: str,
        window: str = "1 minute",
        late: str = "10 minutes",
        by: Sequence[str] = (),
    ) -> None:
        """`schema` names the types of `by`, as DDL."""
        self.spark, self.path, self.time, self.window, self.late, self.by = spark, path.rstrip("/"), time, window, late, list(by)
        self.schema = ", ".join(x for x in ("start timestamp", schema, "n bigint") if x)
        self.micros = spark.sql(f"select unix_micros(timestamp_micros(0) + interval {window})").first()[0]
        # replayed batches need the state before them
        self.state = PublishedTable(spark, f"{self.path}/state", max(2, KEEP))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._before(batch_id)
        newest, opened = self._newest(spark, before), self._open(spark, before)
        at = F.col(self.time)
        if isinstance(batch.schema[self.time].dataType, T.TimestampNTZType):
            at = at.cast("timestamp")
        # one pass over the batch: counts per window, with its newest time
        micros = F.unix_micros(at)
        start = F.timestamp_micros(micros - F.pmod(micros, F.lit(self.micros)))
        counts = (
            batch.select(start.alias("start"), *self.by, at.alias("at"))
            .groupBy("start", *self.by)
            .agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
            .persist()
        )
        try:
            latest = counts.agg(F.max("at")).first()[0]
            is_late = F.col("start").isNull() | self._closed_by(newest)
            rows = counts.drop("at")
            self._write(rows.where(is_late), "late", batch_id)
            every = opened.unionByName(rows.where(~is_late)).groupBy("start", *self.by).agg(F.sum("n").alias("n"))
            newest = max((t for t in (newest, latest) if t is not None), default=None)
            closed = self._closed_by(newest)
            self._write(every.where(closed), "closed", batch_id)

            def write(folder: str) -> None:
                every.where(~closed).write.parquet(f"{folder}/open")
                mark = spark.createDataFrame([(newest,)], "newest timestamp").coalesce(1)
                mark.write.parquet(f"{folder}/newest")

            self.state.publish(write, batch_id)
        finally:
            counts.unpersist()

    def _closed_by(self, newest: datetime | None) -> Column:
        """Whether a window ends at or before the watermark."""
        if newest is None:
            return F.lit(False)
        mark = F.date_trunc("millisecond", F.lit(newest)) - F.expr(f"interval {self.late}")
        return F.coalesce(F.col("start") + F.expr(f"interval {self.window}") <= mark, F.lit(False))

    def _before(self, batch_id: int) -> str | None:
        names = [n for n in self.state.versions() if int(n.partition("-")[0]) < batch_id]
        return f"{self.state.path}/data/{names[-1]}" if names else None

    def _newest(self, spark: SparkSession, folder: str | None) -> datetime | None:
        return spark.read.parquet(f"{folder}/newest").first()[0] if folder else None

    def _open(self, spark: SparkSession, folder: str | None) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{folder}/open") if folder else spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, part: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={batch_id}")

    def read(self) -> DataFrame:
        """All counts so far, as (part, start, by, n): part is closed, late or open."""
        versions = self.state.versions()
        last = f"{self.state.path}/data/{versions[-1]}" if versions else None
        out = self._open(self.spark, last).withColumn("part", F.lit("open"))
        for part in PARTS if versions else ():
            written = self.spark.read.schema(f"{self.schema}, batch bigint").parquet(f"{self.path}/{part}")
            # of a batch whose state is not published yet nothing counts
            done = written.where(F.col("batch") <= self.state.last_number).drop("batch")
            out = out.unionByName(done.withColumn("part", F.lit(part)))
        return out.groupBy("part", "start", *self.by).agg(F.sum("n").alias("n"))
