import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricspark.defs import MetricDef, SourceDef
from metricspark.operators.folds import flat, fold_rows
from metricspark.operators.samples import to_rows
from metricspark.streaming import (
    SnapshotSink,
    per_window_counts,
    read_stream,
    run_available,
    start_snapshots,
    stream_fold,
    stream_gauge,
)

SCHEMA = "id bigint, g string, v double"


@pytest.fixture
def folder(spark, tmp_path):
    """Rows in several files, so that a stream takes them in several batches."""
    path = str(tmp_path / "rows")
    rows = spark.range(300).selectExpr("id", "if(id % 3 = 0, null, concat('g', id % 3)) as g", "cast(id % 50 as double) as v")
    rows.repartition(4).write.parquet(path)
    return path


def stream(spark, folder):
    return read_stream(spark, SourceDef("s", "parquet", folder, schema=SCHEMA), max_files_per_trigger=1)


def found(samples):
    return sorted((r.name + r.suffix, r.labels, round(r.value, 6)) for r in flat(samples).collect())


@pytest.mark.parametrize(
    "metric",
    [
        MetricDef("counter", "m", ""),
        MetricDef("gauge", "m", ""),
        MetricDef("histogram", "m", "", buckets=(10.0, 25.0)),
        MetricDef("summary", "m", "", objectives=(0.5, 0.9), quantiles="sketch"),
    ],
)
def test_stream_equals_batch(spark, folder, metric):
    batch = fold_rows(to_rows(spark.read.parquet(folder).select("g", "v")), [(metric, "m")], {"env": "t"})
    live = stream_fold(stream(spark, folder).select("g", "v"), [(metric, "m")], {"env": "t"})
    assert found(run_available(live, "complete")) == found(batch)


def test_gauges_of_an_aggregate(spark, folder):
    kinds = [(MetricDef("gauge", how, "", order_by="id"), how, how) for how in ("sum", "avg", "min", "max", "last")]
    live = run_available(stream_gauge(stream(spark, folder), kinds), "complete")
    rows = spark.read.parquet(folder).groupBy(F.coalesce("g", F.lit("NULL")).alias("g"))
    want = rows.agg(F.sum("v"), F.avg("v"), F.min("v"), F.max("v"), F.max_by("v", "id")).collect()
    expected = sorted(
        (how, f'g="{r.g}"', round(r[i + 1], 6)) for r in want for i, how in enumerate(("sum", "avg", "min", "max", "last"))
    )
    assert found(live) == expected
    with pytest.raises(ValueError, match="median"):
        stream_gauge(stream(spark, folder), [(MetricDef("gauge", "m", ""), "m", "median")])


def test_append_mode_reads_every_file(spark, folder):
    assert run_available(stream(spark, folder), "append").count() == 300


def test_late_rows_and_open_windows(spark, tmp_path):
    """Rows behind the watermark are dropped, those before it still count, open minutes are held back."""
    path = str(tmp_path / "events")
    base = dt.datetime(2024, 1, 1)

    def write(*minutes):
        rows = [(base + dt.timedelta(minutes=m),) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)

    def run():
        events = read_stream(spark, SourceDef("s", "parquet", path, schema="ts timestamp_ntz"))
        writer = per_window_counts(events, "ts", "1 minute", "10 minutes").writeStream.outputMode("append")
        writer = writer.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        out = spark.read.schema("window_start timestamp, n bigint").parquet(str(tmp_path / "out"))
        minutes = out.select((F.unix_timestamp("window_start") / 60).cast("bigint").alias("m"), "n").collect()
        first = int(base.replace(tzinfo=dt.timezone.utc).timestamp()) // 60
        return {r.m - first: r.n for r in minutes}

    write(0, 0, 5, 12)
    assert run() == {0: 2}
    write(5, 0, 30)
    assert run() == {0: 2, 5: 2, 12: 1}


def test_live_view_moves_from_snapshot_to_snapshot(spark, folder, tmp_path):
    sink = SnapshotSink(spark, str(tmp_path / "live"), view="live_rows")
    with pytest.raises(ValueError, match="nothing has been published"):
        sink.read()
    seen = []

    class Watching(SnapshotSink):
        def __call__(self, batch, batch_id):
            super().__call__(batch, batch_id)
            seen.append(self.spark.table("live_rows").agg(F.sum("value")).first()[0])

    samples = stream_fold(stream(spark, folder).select("g", "v"), [(MetricDef("counter", "m", ""), "m")])
    query = start_snapshots(
        samples, Watching(spark, str(tmp_path / "live"), view="live_rows"), str(tmp_path / "state"), {"availableNow": True}
    )
    query.awaitTermination()
    assert len(seen) == 4 and seen == sorted(seen) and seen[-1] == 300.0
    # another session, as after a restart, finds the newest whole snapshot
    again = SnapshotSink(spark.newSession(), str(tmp_path / "live"))
    assert again.last_batch == 3 and again.read().agg(F.sum("value")).first()[0] == 300.0


def test_streams_take_no_exact_quantiles(spark, folder):
    with pytest.raises(ValueError, match="sketch"):
        stream_fold(stream(spark, folder), [(MetricDef("summary", "m", "", objectives=(0.5,)), "m")])


def test_streams_need_a_schema_and_files(spark, folder):
    with pytest.raises(ValueError, match="schema"):
        read_stream(spark, SourceDef("s", "parquet", folder))
    with pytest.raises(ValueError, match="sql"):
        read_stream(spark, SourceDef("s", "sql", "select 1", schema="x int"))
    with pytest.raises(ValueError, match="order column"):
        metrics = [(MetricDef("gauge", "a", ""), "a"), (MetricDef("gauge", "b", "", order_by="id"), "b")]
        stream_fold(stream(spark, folder), metrics)
