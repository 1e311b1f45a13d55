"""The four metric folds as aggregates over label columns.

Each fold is a list of mergeable aggregates plus the sample rows they turn into. Metrics that
share a query share one aggregation: their aggregates are simply listed together. The same
folds run on streaming frames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.defs import DEFAULT_BUCKETS, MetricDef
from metricspark.functions.numbers import python_number_text
from metricspark.operators.labels import canonical, check_label_name
from metricspark.operators.quantiles import ACCURACY, RANK_ROWS, exact_quantiles, frequency_quantiles
from metricspark.operators.samples import ORDER, VALUE, Rows
from metricspark.session import settle

SAMPLES_SCHEMA = (
    "name string, kind string, help string, base string, pos int, suffix string, "
    "labels map<string,string>, series string, value double"
)

# Rank error of a sketched quantile, as a part of the smallest distance it must tell apart.
SKETCH_ACCURACY = 10000


@dataclass(frozen=True)
class Line:
    """One sample a series emits: `x_bucket{le="1"}`, `x_sum`, or plain `x`. `value` is SQL."""

    suffix: str
    value: str
    label: str | None = None
    label_value: str | None = None


@dataclass(frozen=True)
class Fold:
    """Aggregates over the rows of a series, as SQL, and the lines made of them."""

    metric: MetricDef
    name: str
    aggregates: tuple[str, ...]
    lines: tuple[Line, ...]


def sql_text(s: str | None) -> str:
    if s is None:
        return "cast(null as string)"
    escaped = s.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_double(x: float) -> str:
    return f"double('{x!r}')"


def gauge(metric: MetricDef, name: str, tag: str = "m") -> Fold:
    """The last row of each label set wins: last by `order_by`, else the greatest value."""
    if metric.order_by is None:
        agg = f"max({VALUE})"
    else:
        # equal order values are settled by the greatest value, so reruns agree
        agg = f"max(struct({ORDER}, {VALUE})).{VALUE}"
    return Fold(metric, name, (f"{agg} as {tag}_last",), (Line("", f"{tag}_last"),))


AGGREGATES = ("sum", "avg", "min", "max")


def aggregate_gauge(metric: MetricDef, name: str, how: str, tag: str = "m") -> Fold:
    """A gauge whose value is an aggregate of its rows; `last` is the plain gauge."""
    if how == "last":
        return gauge(metric, name, tag)
    if how not in AGGREGATES:
        raise ValueError(f"metric {metric.name}: {how!r} is none of last, {', '.join(AGGREGATES)}")
    return Fold(metric, name, (f"{how}({VALUE}) as {tag}_{how}",), (Line("", f"{tag}_{how}"),))


def counter(metric: MetricDef, name: str, tag: str = "m") -> Fold:
    """Rows per label set; the value column does not matter."""
    return Fold(metric, name, (f"count(1) as {tag}_rows",), (Line("", f"{tag}_rows"),))


def _sum_and_count(tag: str) -> tuple[tuple[str, ...], tuple[Line, ...]]:
    aggs = (f"sum({VALUE}) as {tag}_sum", f"count(1) as {tag}_count")
    return aggs, (Line("_sum", f"{tag}_sum"), Line("_count", f"{tag}_count"))


def histogram(metric: MetricDef, name: str, tag: str = "m") -> Fold:
    """Cumulative counts of values up to each bound, then +Inf, sum and count, in one pass."""
    bounds = metric.buckets or DEFAULT_BUCKETS
    totals, total_lines = _sum_and_count(tag)
    aggs = tuple(f"count_if({VALUE} <= {sql_double(b)}) as {tag}_le_{i}" for i, b in enumerate(bounds))
    lines = tuple(Line("_bucket", f"{tag}_le_{i}", "le", python_number_text(b)) for i, b in enumerate(bounds))
    if bounds[-1] != float("inf"):
        lines += (Line("_bucket", f"{tag}_count", "le", "+Inf"),)
    return Fold(metric, name, aggs + totals, lines + total_lines)


def objectives(metric: MetricDef) -> list[float]:
    return sorted(set(metric.objectives))


def quantile_lines(metric: MetricDef, columns: Sequence[str]) -> tuple[Line, ...]:
    return tuple(Line("", c, "quantile", python_number_text(q)) for q, c in zip(objectives(metric), columns))


def summary_sketch(metric: MetricDef, name: str, tag: str = "m") -> Fold:
    """Quantiles from a mergeable sketch of bounded size; the rank error is far below every objective."""
    qs = objectives(metric)
    totals, total_lines = _sum_and_count(tag)
    if not qs:
        return Fold(metric, name, totals, total_lines)
    distances = [d for q in qs for d in (q, 1 - q) if d > 0]
    accuracy = max(SKETCH_ACCURACY, int(10 / min(distances, default=1)))
    wanted = ", ".join(sql_double(q) for q in qs)
    sketch = f"percentile_approx({VALUE}, array({wanted}), {accuracy}) as {tag}_quantiles"
    columns = [f"{tag}_quantiles[{i}]" for i in range(len(qs))]
    return Fold(metric, name, (*totals, sketch), quantile_lines(metric, columns) + total_lines)


BUILDERS = {"gauge": gauge, "counter": counter, "histogram": histogram, "summary": summary_sketch}

# Labels that a kind adds itself.
RESERVED_LABELS = {"histogram": "le", "summary": "quantile"}


def check_labels(metric: MetricDef, labels: Iterable[str]) -> None:
    reserved = RESERVED_LABELS.get(metric.kind)
    if reserved in labels:
        raise ValueError(f"metric {metric.name}: {reserved!r} cannot be a query label of a {metric.kind}")


def emit(series: DataFrame, rows: Rows, folds: Sequence[Fold], global_labels: Mapping[str, str]) -> DataFrame:
    """Aggregated series to sample rows. Runs once per series, after all shuffles."""
    for k in global_labels:
        check_label_name(k)
    texts = dict(zip(rows.labels, rows.texts)) | {k: F.lit(v) for k, v in global_labels.items()}
    pairs = [x for k, c in texts.items() for x in (F.lit(k), c)]
    label_map = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    lines = ", ".join(
        f"named_struct('name', {sql_text(fold.name)}, 'kind', '{fold.metric.kind}', "
        f"'help', {sql_text(fold.metric.help)}, 'pos', {pos}, 'suffix', '{line.suffix}', "
        f"'extra', {sql_text(line.label)}, 'extra_value', {sql_text(line.label_value)}, "
        f"'value', cast({line.value} as double))"
        for fold in folds
        for pos, line in enumerate(fold.lines)
    )
    out = series.select(
        canonical(texts).alias("base"), label_map.alias("base_labels"), F.expr(f"inline(array({lines}))")
    )
    return out.selectExpr(
        "name",
        "kind",
        "help",
        "base",
        "pos",
        "suffix",
        "if(extra is null, base_labels, map_concat(base_labels, map(extra, extra_value))) as labels",
        "concat(base, if(extra is null, '', concat(if(base = '', '', ','), extra, '=\"', extra_value, '\"'))) as series",
        "value",
    )


def fold_rows(
    rows: Rows, metrics: Sequence[tuple[MetricDef, str]], global_labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Fold the rows of one query into every metric that uses it."""
    folds = [BUILDERS[metric.kind](metric, name, f"m{i}") for i, (metric, name) in enumerate(metrics)]
    return apply_folds(rows, folds, global_labels)


def apply_folds(rows: Rows, folds: Sequence[Fold], global_labels: Mapping[str, str] | None = None) -> DataFrame:
    """One aggregation and one shuffle for all folds of the same rows."""
    for fold in folds:
        check_labels(fold.metric, [*rows.labels, *(global_labels or {})])
    aggs = [F.expr(a) for f in folds for a in f.aggregates]
    if rows.keys:
        series = rows.frame.groupBy(*rows.keys).agg(*aggs)
    else:
        # without labels an empty result still aggregates to one row, which is no series
        series = rows.frame.agg(F.expr("count(1) as rows_seen"), *aggs).where("rows_seen > 0")
    return emit(series, rows, folds, global_labels or {})


def summary_exact(
    rows: Rows,
    metric: MetricDef,
    name: str,
    global_labels: Mapping[str, str] | None = None,
    rank_rows: int = RANK_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """A summary whose quantiles are the exact discrete quantiles of its series.

    The groups of a query are ranked from their frequencies, in the one evaluation of the query; other rows,
    and groups that are `stage`d as there are very many, by two scans.
    """
    check_labels(metric, [*rows.labels, *(global_labels or {})])
    qs = objectives(metric)
    if rows.grouped and not metric.stage:
        series = frequency_quantiles(rows.frame, rows.keys, VALUE, qs)
    else:
        frame = settle(rows.frame) if metric.stage else rows.frame
        series = exact_quantiles(frame, rows.keys, VALUE, qs, rank_rows, accuracy)
    return emit_summary(series, rows, metric, name, global_labels)


def emit_summary(
    series: DataFrame, rows: Rows, metric: MetricDef, name: str, global_labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Ranked series to sample rows."""
    return emit(series, rows, [ranked_fold(metric, name, objectives(metric))], global_labels or {})


def ranked_fold(metric: MetricDef, name: str, ranked: Sequence[float]) -> Fold:
    """The lines of a summary from a series' `n`, `total`, and a `q_` column per ranked quantile."""
    lines = quantile_lines(metric, [f"q_{ranked.index(q)}" for q in objectives(metric)])
    return Fold(metric, name, (), (*lines, Line("_sum", "total"), Line("_count", "n")))


def flat(samples: DataFrame) -> DataFrame:
    """Samples as plain columns, with the labels as one text."""
    return samples.select("name", "kind", "suffix", F.col("series").alias("labels"), "value")
