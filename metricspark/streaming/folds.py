"""The metric folds on streams.

All folds are mergeable aggregates, so a stream keeps one small state per series. Quantiles use
the sketch, whose size is bounded; exact ones would have to keep every value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricspark.defs import MetricDef
from metricspark.operators.folds import aggregate_gauge, apply_folds, fold_rows
from metricspark.operators.samples import to_rows


def stream_fold(
    stream: DataFrame, metrics: Sequence[tuple[MetricDef, str]], global_labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Samples of a streaming query, for complete or update mode. Summaries must ask for the sketch."""
    exact = [name for m, name in metrics if m.kind == "summary" and m.quantiles != "sketch"]
    if exact:
        raise ValueError(f"a stream keeps no values to rank: {', '.join(exact)} must set quantiles to 'sketch'")
    rows = to_rows(stream, _order_column([m for m, _ in metrics]), global_labels)
    return fold_rows(rows, metrics, global_labels)


def stream_gauge(
    stream: DataFrame, gauges: Sequence[tuple[MetricDef, str, str]], global_labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Gauges of an aggregate as (metric, name, how), how being sum, avg, min, max or last.

    A batch metric would aggregate in its SQL and fold the result; a stream does both at once, as
    it can aggregate only one time in complete mode.
    """
    rows = to_rows(stream, _order_column([m for m, _, _ in gauges]), global_labels)
    folds = [aggregate_gauge(m, name, how, f"m{i}") for i, (m, name, how) in enumerate(gauges)]
    return apply_folds(rows, folds, global_labels)


def _order_column(metrics: Sequence[MetricDef]) -> str | None:
    order_by = {m.order_by for m in metrics}
    if len(order_by) != 1:
        raise ValueError("metrics folded together must name the same order column")
    return order_by.pop()


def per_window_counts(
    stream: DataFrame, time: str, window: str = "1 minute", late: str = "10 minutes", by: Sequence[str | Column] = ()
) -> DataFrame:
    """Rows per time window, emitted once the watermark has passed the window's end.

    Rows up to `late` behind the newest are counted; state of closed windows is dropped.
    """
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        # watermarks need a point in time
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    marked = stream.withWatermark(time, late)
    counts = marked.groupBy(F.window(time, window).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))
    named = [c for c in counts.columns if c not in ("window", "n")]
    return counts.select(F.col("window.start").alias("window_start"), *named, "n")
