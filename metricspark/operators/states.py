"""Folds as states that are stored and merged: per hour, per refresh, by batches and streams alike.

A state is a row per series with the aggregates of some of its rows. States of different rows of a series are merged by
aggregates again, in any order and grouping, and only then become samples. Quantiles are kept as KLL sketches, whose rank
error holds however often they are merged.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.defs import MetricDef
from metricspark.operators.folds import Fold, Line, check_labels, counter, emit, histogram, objectives, quantile_lines
from metricspark.operators.samples import ORDER, VALUE, Rows

Named = tuple[MetricDef, str]

# Fixed values of KLL sketches: with parameter k the rank error is at most FACTOR / k ** POWER of the rows in 99 % of
# all cases; and the largest k.
KLL_FACTOR, KLL_POWER, KLL_LARGEST = 2.296, 0.9021, 65535
# Rank error, as a part of the smallest distance of an objective to 0 or 1, and the least a sketch is asked for.
SHARE, LEAST_ERROR = 0.1, 0.01


@dataclass(frozen=True)
class StateColumn:
    """A column of a state: what makes it of rows, and what makes one of several."""

    name: str
    of_rows: str
    of_states: str


def sketch_size(qs: Sequence[float]) -> int:
    """The parameter k of a sketch that tells the objectives from 0 and 1, and from each other within a percent."""
    error = min([LEAST_ERROR, *(SHARE * d for q in qs for d in (q, 1 - q) if d > 0)])
    return min(KLL_LARGEST, math.ceil((KLL_FACTOR / error) ** (1 / KLL_POWER)))


def rank_error(k: int) -> float:
    return KLL_FACTOR / k**KLL_POWER


def _columns(metric: MetricDef, name: str, tag: str) -> tuple[list[StateColumn], Fold]:
    """A metric's state, and its lines from a merged one."""
    if metric.kind == "gauge":
        ordered = metric.order_by is not None
        last = StateColumn(f"{tag}_last", f"max(struct({ORDER}, {VALUE}))" if ordered else f"max({VALUE})", f"max({tag}_last)")
        return [last], Fold(metric, name, (), (Line("", f"{tag}_last.{VALUE}" if ordered else f"{tag}_last"),))
    if metric.kind in ("counter", "histogram"):
        fold = counter(metric, name, tag) if metric.kind == "counter" else histogram(metric, name, tag)
        columns = [text.rsplit(" as ", 1) for text in fold.aggregates]
        return [StateColumn(c, a, f"sum({c})") for a, c in columns], fold
    qs = objectives(metric)
    columns = [
        StateColumn(f"{tag}_sum", f"sum({VALUE})", f"sum({tag}_sum)"),
        StateColumn(f"{tag}_count", "count(1)", f"sum({tag}_count)"),
    ]
    if qs:
        k = sketch_size(qs)
        sketch = f"kll_sketch_agg_double({VALUE}, {k})"
        columns.append(StateColumn(f"{tag}_sketch", sketch, f"kll_merge_agg_double({tag}_sketch, {k})"))
    found = [f"kll_sketch_get_quantile_double({tag}_sketch, double('{q!r}'))" for q in qs]
    lines = quantile_lines(metric, found)
    return columns, Fold(metric, name, (), (*lines, Line("_sum", f"{tag}_sum"), Line("_count", f"{tag}_count")))


def _all_columns(metrics: Sequence[Named]) -> list[StateColumn]:
    return [c for i, (m, name) in enumerate(metrics) for c in _columns(m, name, f"m{i}")[0]]


def make_states(rows: Rows, metrics: Sequence[Named], by: Sequence[str] = ()) -> DataFrame:
    """One state per series of `rows`, which all metrics share, and per value of further columns."""
    for m, _ in metrics:
        check_labels(m, rows.labels)
    if rows.grouped:
        raise ValueError("groups of all rows cannot be merged from groups of some; fold the rows themselves")
    columns = [F.expr(c.of_rows).alias(c.name) for c in _all_columns(metrics)]
    keys = [*by, *rows.keys]
    states = rows.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_seen"), *columns)
    return states.where("rows_seen > 0")


def merge_states(states: DataFrame, keys: Sequence[str], metrics: Sequence[Named]) -> DataFrame:
    """States of the same keys as one."""
    columns = [F.expr(c.of_states).alias(c.name) for c in _all_columns(metrics)]
    merged = states.groupBy(*keys).agg(F.sum("rows_seen").alias("rows_seen"), *columns)
    return merged.where("rows_seen > 0")


def state_samples(
    states: DataFrame, rows: Rows, metrics: Sequence[Named], global_labels: Mapping[str, str] | None = None
) -> DataFrame:
    """The samples of all states together. `rows` tells the labels; its frame is not read."""
    folds = [_columns(m, name, f"m{i}")[1] for i, (m, name) in enumerate(metrics)]
    return emit(merge_states(states, rows.keys, metrics), rows, folds, global_labels or {})
