"""The folds on streams of files, compared with what the same rows give in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.checks import oracle as o
from metricspark.checks.harness import check, rounded, table
from metricspark.defs import MetricDef, SourceDef
from metricspark.operators.folds import SKETCH_ACCURACY, flat
from metricspark.operators.samples import to_rows
from metricspark.operators.states import make_states, merge_states, rank_error, sketch_size
from metricspark.session import new_work_path
from metricspark.streaming import (
    SnapshotSink,
    WindowCounts,
    per_window_counts,
    read_stream,
    run_available,
    start_snapshots,
    stream_fold,
    stream_gauge,
)

KIND = {"event_type": o.text("event_type")}


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return read_stream(spark, SourceDef("events", "parquet", f"{sf_dir}/events.parquet", schema=schema))


def _folded(stream: DataFrame, metric: MetricDef) -> DataFrame:
    return rounded(flat(run_available(stream_fold(stream, [(metric, metric.name)]), "complete")))


@check("d01_file_stream", "select event_id, user_id, event_type, value from events")
def file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(events_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value"), "append")


@check("d02_stream_counter", o.counter("seen", KIND, "events"))
def stream_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(events_stream(spark, sf_dir).select("event_type", "value"), MetricDef("counter", "seen", ""))


@check(
    "d03_stream_gauge",
    o.union(
        o.gauge("total", KIND, "a", "(select event_type, sum(value) as a from events group by all) g"),
        o.gauge("mean", KIND, "a", "(select event_type, avg(value) as a from events group by all) g"),
        o.gauge("newest", KIND, "a", "(select event_type, max_by(value, event_id) as a from events group by all) g"),
    ),
)
def stream_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges of an aggregate: a sum, a mean, and the newest value."""
    stream = events_stream(spark, sf_dir).select("event_type", "value", "event_id")
    gauges = [
        (MetricDef("gauge", "total", "", order_by="event_id"), "sum"),
        (MetricDef("gauge", "mean", "", order_by="event_id"), "avg"),
        (MetricDef("gauge", "newest", "", order_by="event_id"), "last"),
    ]
    return rounded(flat(run_available(stream_gauge(stream, [(m, m.name, how) for m, how in gauges]), "complete")))


BOUNDS = (1.0, 5.0, 10.0, 50.0)


@check("d04_stream_histogram", o.histogram("spent", KIND, "value", "events", BOUNDS))
def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = events_stream(spark, sf_dir).select("event_type", "value")
    return _folded(stream, MetricDef("histogram", "spent", "", buckets=BOUNDS))


SPENT = MetricDef("summary", "spent", "", objectives=(0.5, 0.9, 0.99), quantiles="sketch")


@check("d05_stream_summary")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched quantiles; the rank error is checked below, equality is not promised."""
    return _folded(events_stream(spark, sf_dir).select("event_type", "value"), SPENT)


@check(
    "d05_stream_rank_error",
    "select event_type, cast(q as double) as quantile, count(*) as n, true as within_error "
    "from events, (values (0.5), (0.9), (0.99)) o(q) group by all",
)
def stream_rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each streamed quantile lies within the promised part of its series' rows."""
    stream = events_stream(spark, sf_dir).select("event_type", "value")
    sketch = run_available(stream_fold(stream, [(SPENT, "spent")]), "complete").where("suffix = ''")
    found = sketch.select(
        F.col("labels")["event_type"].alias("event_type"),
        F.col("labels")["quantile"].cast("double").alias("quantile"),
        F.col("value").alias("found"),
    )
    events = table(spark, sf_dir, "events").select("event_type", "value")
    ranks = events.join(found, "event_type").groupBy("event_type", "quantile").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value") < F.col("found")).alias("below"),
        F.count_if(F.col("value") <= F.col("found")).alias("upto"),
    )
    allowed, target = F.col("n") / SKETCH_ACCURACY + 1, F.col("quantile") * F.col("n")
    within = (target >= F.col("below") - allowed) & (target <= F.col("upto") + allowed)
    return ranks.select("event_type", "quantile", "n", within.alias("within_error"))


@check(
    "d05_stored_sketches",
    "select event_type, cast(q as double) as quantile, count(*) as n, true as within_error "
    "from events, (values (0.5), (0.9), (0.99)) o(q) group by all",
)
def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all events from states stored per hour, those of even days by a batch and of odd days by a stream,
    and whether each lies within the sketch's rank error."""
    events, metrics = table(spark, sf_dir, "events"), [(SPENT, "spent")]
    query = "select event_type, value as v, date_trunc('hour', ts) as hour from {rows} where day(ts) % 2 = {odd}"

    def states(rows: DataFrame, odd: int) -> DataFrame:
        chosen = to_rows(rows.sparkSession.sql(query.format(rows="{rows}", odd=odd), rows=rows))
        return make_states(chosen, metrics)

    path = new_work_path(spark, "hours")
    states(events, 0).write.mode("append").parquet(path)
    write = lambda batch, _: states(batch, 1).write.mode("append").parquet(path)
    streamed = events_stream(spark, sf_dir).writeStream.foreachBatch(write)
    checkpoint = new_work_path(spark, "hours-checkpoint")
    streamed.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    # the hour is the second of the keys; a day's, or all, come from merging without it
    merged = merge_states(spark.read.parquet(path), ["key_0"], metrics)
    quantiles = [F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_double("m0_sketch", F.lit(q)).alias("found")) for q in SPENT.objectives]
    found = merged.select(F.col("key_0").alias("event_type"), F.inline(F.array(*quantiles)))
    ranks = events.select("event_type", "value").join(found, "event_type").groupBy("event_type", "quantile").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value") < F.col("found")).alias("below"),
        F.count_if(F.col("value") <= F.col("found")).alias("upto"),
    )
    allowed = F.col("n") * 2 * rank_error(sketch_size(SPENT.objectives)) + 1
    target = F.col("quantile") * F.col("n")
    within = (target >= F.col("below") - allowed) & (target <= F.col("upto") + allowed)
    return ranks.select("event_type", "quantile", "n", within.alias("within_error"))


def _closed(late: str) -> str:
    return f"""select strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute, event_type, count(*) as n
    from events
    where date_trunc('minute', ts) + interval 1 minute <= (select date_trunc('millisecond', max(ts)) - interval 10 minute from events)
    and {late}
    group by all"""


def _minutes(stream: DataFrame) -> DataFrame:
    counts = run_available(per_window_counts(stream, "ts", "1 minute", "10 minutes", ["event_type"]), "append")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("minute"), "event_type", "n")


@check("d06_rate_with_late_data", _closed("true"))
def rate_with_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of closed minutes; the last open ones are held back."""
    return _minutes(events_stream(spark, sf_dir).select("ts", "event_type"))


ARRIVALS = ("event_id % 9 not in (4, 5)", "event_id % 9 = 5", "event_id % 9 = 4")


@check(
    "d06_rate_drops_late_rows",
    _closed(
        f"(not {ARRIVALS[2]} or date_trunc('minute', ts) + interval 1 minute > "
        f"(select date_trunc('millisecond', max(ts)) - interval 10 minute from events where {ARRIVALS[0]}))"
    ),
)
def rate_drops_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come in three files, one batch each. What the first says about time holds for rows that come
    after the second batch: those of the third whose minutes it closed are late and do not count."""
    path = new_work_path(spark, "late")
    events = table(spark, sf_dir, "events").select("ts", "event_type", "event_id")
    for some in ARRIVALS:
        # one file each, as a stream takes files one by one, by their time of change
        events.where(some).select("ts", "event_type").repartition(1).write.mode("append").parquet(path)
    source = SourceDef("late", "parquet", path, schema="ts timestamp_ntz, event_type string")
    return _minutes(read_stream(spark, source, max_files_per_trigger=1))


MARK = "(select date_trunc('millisecond', max(ts)) - interval 10 minute from events where {})"


def _parts_oracle() -> str:
    end = "date_trunc('minute', ts) + interval 1 minute"
    first, second = MARK.format(ARRIVALS[0]), MARK.format(f"({ARRIVALS[0]}) or ({ARRIVALS[1]})")
    late = f"(({ARRIVALS[1]}) and {end} <= {first} or ({ARRIVALS[2]}) and {end} <= {second})"
    part = f"case when {late} then 'late' when {end} <= {MARK.format('true')} then 'closed' else 'open' end"
    return f"""select {part} as part, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute, event_type,
    count(*) as n from events group by all"""


@check("d06_late_rows_apart", _parts_oracle())
def late_rows_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come in three batches; those behind what the batches before have closed are counted as late, and all parts
    together hold every row."""
    path, events = new_work_path(spark, "arrivals"), table(spark, sf_dir, "events").select("ts", "event_type", "event_id")
    sink = WindowCounts(spark, new_work_path(spark, "windows"), "event_type string", "ts", by=["event_type"])
    checkpoint = new_work_path(spark, "windows-checkpoint")
    for some in ARRIVALS:
        # the files that are there by then are one batch
        events.where(some).select("ts", "event_type").write.mode("append").parquet(path)
        rows = read_stream(spark, SourceDef("arrivals", "parquet", path, schema="ts timestamp_ntz, event_type string"))
        writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    minute = F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("minute")
    return sink.read().select("part", minute, "event_type", "n")


@check("d07_live_snapshot", o.counter("seen", KIND, "events"))
def live_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that always shows the newest whole snapshot of a running query."""
    stream = events_stream(spark, sf_dir).select("event_type", "value")
    sink = SnapshotSink(spark, new_work_path(spark, "live"), view="live_samples")
    samples = stream_fold(stream, [(MetricDef("counter", "seen", ""), "seen")])
    start_snapshots(samples, sink, new_work_path(spark, "live-checkpoint"), {"availableNow": True}).awaitTermination()
    return rounded(flat(spark.table("live_samples")))
