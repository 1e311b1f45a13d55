"""Metrics over one source in one aggregation of its rows.

Metrics that name a source instead of a query have labels, a filter and a value each. Their labels become grouping
sets of one grouping, their filters FILTER clauses of its aggregates: gauges, counters, histograms, sketches, the groups
that summaries are made of, and the brackets of exact quantiles all come from the same scan. What it yields, a row per
group, is kept in the shared folder, and every metric's samples are made from it. Exact summaries of the rows then need
one more scan, which those with the same labels share, told apart by a further key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.defs import MetricDef
from metricspark.operators.folds import (
    Fold,
    Line,
    counter,
    emit,
    emit_summary,
    histogram,
    objectives,
    ranked_fold,
    summary_sketch,
)
from metricspark.operators.labels import check_label_name
from metricspark.operators.quantiles import bracket_aggregates, bracket_columns, exact_quantiles, frequency_quantiles
from metricspark.operators.samples import VALUE, Rows, group_key, to_value
from metricspark.session import settle
from metricspark.sources.read import sql

Named = tuple[MetricDef, str]

# of the exact summaries with the same labels, whose rows a row is
WHICH = "which"


class FusedMetrics:
    """Metrics over one source, planned when made; `build` runs the aggregation and returns their samples by name."""

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        metrics: Sequence[Named],
        variables: Mapping[str, Any] | None = None,
        global_labels: Mapping[str, str] | None = None,
    ):
        self.metrics, self.global_labels = list(metrics), dict(global_labels or {})
        for m, _ in metrics:
            for label, _ in m.by:
                check_label_name(label)
        self.names: dict[str, str] = {}  # columns of the source's rows, by expression
        self.by = [[(n, self._column("key", e)) for n, e in m.by] for m, _ in metrics]
        self.each = [[self._column("key", e) for e in m.each] for m, _ in metrics]
        self.where = [self._column("cond", m.where) if m.where else None for m, _ in metrics]
        self.values = [self._column("row", m.value or "0") if self._of_rows(m) else None for m, _ in metrics]
        added = [f"{e} as {c}" for e, c in ((e, c) for (_, e), c in self.names.items())]
        rows = sql(spark, f"select {', '.join(['*', *added])} from {source}", variables)
        types = {f.name: f.dataType for f in rows.schema.fields}
        self.texts: dict[str, Column] = {}
        for c in self.names.values():
            if c.startswith("fused_key"):
                key, self.texts[c] = group_key(F.col(c), types[c], c)
                rows = rows.withColumn(c, key)
            elif c.startswith("fused_row"):
                rows = rows.withColumn(c, to_value(F.col(c), types[c]))
        self.rows = rows
        self.keys = [c for c in self.names.values() if c.startswith("fused_key")]
        self.sets = list(dict.fromkeys(tuple(self._set(i)) for i in range(len(self.metrics))))
        self.nothing: DataFrame | None = None
        self.exact = self._exact()
        self.grouped = self._grouped()

    def _column(self, kind: str, expression: str) -> str:
        return self.names.setdefault((kind, expression), f"fused_{kind}_{len(self.names)}")

    @staticmethod
    def _of_rows(m: MetricDef) -> bool:
        """Whether the metric's value is of a row, not of a group."""
        return m.kind in ("counter", "histogram") or m.kind == "summary" and not m.each

    def _set(self, i: int) -> list[str]:
        chosen = {*(c for _, c in self.by[i]), *self.each[i]}
        return [c for c in self.names.values() if c in chosen]

    def _exact(self) -> dict[tuple[str, ...], list[int]]:
        """The exact summaries of rows, by their grouping set."""
        out: dict[tuple[str, ...], list[int]] = {}
        for i, (m, _) in enumerate(self.metrics):
            if m.kind == "summary" and not m.each and m.quantiles == "exact" and m.objectives:
                out.setdefault(tuple(self._set(i)), []).append(i)
        return out

    def _ranked(self, i: int) -> list[float]:
        """Quantiles ranked together with those of a metric."""
        return sorted({q for j in self.exact[tuple(self._set(i))] for q in objectives(self.metrics[j][0])})

    def _filtered(self, aggregate: str, i: int, alias: str) -> Column:
        text = aggregate.replace(VALUE, self.values[i] or VALUE)
        return F.expr(f"{text} filter (where {self.where[i]})" if self.where[i] else text).alias(alias)

    def _fold(self, i: int) -> Fold | None:
        """The aggregates and lines of a metric made of one group each."""
        m, name = self.metrics[i]
        tag = f"m{i}"
        if m.kind == "counter":
            return counter(m, name, tag)
        if m.kind == "histogram":
            return histogram(m, name, tag)
        if m.kind == "summary" and not m.each and not any(i in some for some in self.exact.values()):
            return summary_sketch(m, name, tag)
        return None

    def _grouped(self) -> DataFrame:
        """A row per group of every grouping set, with the aggregates of all metrics."""
        out: dict[str, Column] = {}
        for i, (m, _) in enumerate(self.metrics):
            out[f"m{i}_seen"] = self._filtered("count(1)", i, f"m{i}_seen")
            if m.kind == "gauge" or m.each:
                out[f"m{i}_value"] = self._filtered(m.value or "0", i, f"m{i}_value")
            elif fold := self._fold(i):
                for text in fold.aggregates:
                    aggregate, alias = text.rsplit(" as ", 1)
                    out[alias] = self._filtered(aggregate, i, alias)
            else:
                for alias, aggregate in bracket_aggregates(VALUE, self._ranked(i)).items():
                    out[f"m{i}_{alias}"] = self._filtered(aggregate, i, f"m{i}_{alias}")
        if len(self.sets) == 1:
            number = F.lit(self._number(self.sets[0]))
            grouped = self.rows.groupBy(*self.sets[0]).agg(number.alias("grouping"), *out.values())
        else:
            sets = [[F.col(c) for c in some] for some in self.sets]
            grouped = self.rows.groupingSets(sets, *[F.col(c) for c in self.keys]).agg(
                F.grouping_id().alias("grouping"), *out.values()
            )
        if () in self.sets and len(self.sets) > 1:
            # grouping sets of no rows have no groups, but an aggregate without labels has a value
            nothing = self.rows.where(F.lit(False)).agg(F.lit(self._number(())).alias("grouping"), *out.values())
            self.nothing = self._as_values(nothing, out)
        return self._as_values(grouped, out)

    @staticmethod
    def _as_values(grouped: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
        types = {f.name: f.dataType for f in grouped.schema.fields}
        values = {c: to_value(F.col(c), types[c]) for c in aggregates if c.endswith("_value")}
        return grouped.withColumns(values) if values else grouped

    def _number(self, some: Sequence[str]) -> int:
        """What grouping_id() is for a grouping set: a bit for every key that is not in it."""
        return sum(1 << (len(self.keys) - 1 - k) for k, c in enumerate(self.keys) if c not in some)

    def build(self) -> dict[str, DataFrame]:
        groups = settle(self.grouped)
        if self.nothing is not None and groups.isEmpty():
            groups = groups.unionByName(self.nothing, allowMissingColumns=True)
        parts: dict[str, DataFrame] = {}
        together: dict[tuple, list[int]] = {}
        for i, (m, name) in enumerate(self.metrics):
            mine = groups.where(F.col("grouping") == self._number(self._set(i)))
            rows = Rows(mine, tuple(n for n, _ in self.by[i]), tuple(self.texts[c] for _, c in self.by[i]), True)
            seen = F.col(f"m{i}_seen") > 0
            if m.each:
                keys = [c for _, c in self.by[i]]
                ranked = frequency_quantiles(mine.where(seen), keys, f"m{i}_value", objectives(m))
                parts[name] = emit_summary(ranked, rows, m, name, self.global_labels)
            elif m.top is not None:
                order = [F.desc(f"m{i}_value"), *(F.col(c) for _, c in self.by[i])]
                best = mine.where(seen).orderBy(*order).limit(m.top)
                parts[name] = emit(best, rows, [Fold(m, name, (), (Line("", f"m{i}_value"),))], self.global_labels)
            elif not any(i in some for some in self.exact.values()):
                together.setdefault((tuple(self._set(i)), tuple(self.by[i])), []).append(i)
        for some in together.values():
            parts[" ".join(self.metrics[i][1] for i in some)] = self._folded(groups, some)
        for key, some in self.exact.items():
            parts.update(self._summaries(groups, key, some))
        return parts

    def _folded(self, groups: DataFrame, some: list[int]) -> DataFrame:
        """Metrics with the same labels from the same groups."""
        folds = []
        for i in some:
            m, name = self.metrics[i]
            fold = self._fold(i) or Fold(m, name, (), (Line("", f"m{i}_value"),))
            # a gauge without labels is there even if no row is
            always = m.kind == "gauge" and not self.by[i]
            lines = [
                line if always else Line(line.suffix, f"if(m{i}_seen > 0, {line.value}, null)", line.label, line.label_value)
                for line in fold.lines
            ]
            folds.append(Fold(m, name, (), tuple(lines)))
        by = self.by[some[0]]
        mine = groups.where(F.col("grouping") == self._number(self._set(some[0])))
        rows = Rows(mine, tuple(n for n, _ in by), tuple(self.texts[c] for _, c in by), True)
        return emit(mine, rows, folds, self.global_labels).where("value is not null")

    def _summaries(self, groups: DataFrame, key: tuple[str, ...], some: list[int]) -> dict[str, DataFrame]:
        """Exact summaries of rows with the same labels: one ranking, with the metric as a key."""
        qs = self._ranked(some[0])
        mine = groups.where(F.col("grouping") == self._number(key))
        brackets = [
            mine.where(f"m{i}_seen > 0").selectExpr(*key, f"{i} as {WHICH}", *bracket_columns(qs, tag=f"m{i}_")) for i in some
        ]
        entries = [f"named_struct('{WHICH}', {i}, 'v', {self.values[i]}, 'held', {self.where[i] or 'true'})" for i in some]
        rows = self.rows.select(*key, F.expr(f"inline(array({', '.join(entries)}))")).where("held")
        all_brackets = brackets[0]
        for other in brackets[1:]:
            all_brackets = all_brackets.union(other)
        ranked = exact_quantiles(rows, [*key, WHICH], "v", qs, brackets=all_brackets)
        together: dict[tuple, list[int]] = {}
        for i in some:
            together.setdefault(tuple(self.by[i]), []).append(i)
        parts = {}
        for by, mine_too in together.items():
            folds = []
            for i in mine_too:
                fold = ranked_fold(*self.metrics[i], qs)
                lines = [Line(x.suffix, f"if({WHICH} = {i}, {x.value}, null)", x.label, x.label_value) for x in fold.lines]
                folds.append(Fold(fold.metric, fold.name, (), tuple(lines)))
            shape = Rows(ranked, tuple(n for n, _ in by), tuple(self.texts[c] for _, c in by))
            out = emit(ranked, shape, folds, self.global_labels).where("value is not null")
            parts[" ".join(self.metrics[i][1] for i in mine_too)] = out
        return parts
