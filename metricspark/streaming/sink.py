"""Streamed samples as a table that always holds one whole snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from metricspark.publish import KEEP, PublishedTable
from metricspark.session import new_work_path


class SnapshotSink:
    """Takes each batch of a complete-mode query as the new snapshot.

    A batch is published as a version of a table, under its own number, and the newest version is the snapshot: to this
    driver after a restart, and to any other session. A batch that runs again after a failure is another version of the
    same number, so no reader is disturbed. However many batches there were, only the newest versions are kept.
    """

    def __init__(self, spark: SparkSession, path: str, view: str | None = None, keep: int = KEEP) -> None:
        # batches arrive in a session of their own; the view belongs to the caller's
        self.spark = spark
        self.view = view
        self.published = PublishedTable(spark, path, keep)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.published.write(batch, batch_id)
        if self.view is not None:
            self.read().createOrReplaceTempView(self.view)

    @property
    def last_batch(self) -> int | None:
        return self.published.last_number

    def read(self) -> DataFrame:
        return self.published.read()


def start_snapshots(
    samples: DataFrame, sink: SnapshotSink, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    writer = samples.writeStream.outputMode("complete").foreachBatch(sink)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all files present, then read what it wrote.

    In complete mode this is the last snapshot; in append mode all rows emitted.
    """
    spark = stream.sparkSession
    path, checkpoint = new_work_path(spark, "stream-out"), new_work_path(spark, "stream-checkpoint")
    if mode == "complete":
        sink = SnapshotSink(spark, path)
        start_snapshots(stream, sink, checkpoint, {"availableNow": True}).awaitTermination()
        return spark.createDataFrame([], stream.schema) if sink.last_batch is None else sink.read()
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
