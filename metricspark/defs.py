"""Declarative definitions: what to read, which macros to create, which metrics to compute.

These hold only names, SQL text and settings. They are loaded from YAML or dicts on the
driver; the data itself never passes through them.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import yaml

KINDS = ("gauge", "counter", "summary", "histogram")

# Bucket bounds used by metrics clients when a histogram lists none.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


@dataclass(frozen=True)
class SourceDef:
    """A named relation. An unknown `type` is treated as SQL."""

    name: str
    type: str = "sql"
    source: str = ""
    materialize: bool = False
    refresh_interval_seconds: int = 0
    schema: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> SourceDef:
        return cls(
            name=d["name"],
            type=d.get("type", "sql"),
            source=d.get("source", ""),
            materialize=bool(d.get("materialize", False)),
            refresh_interval_seconds=int(d.get("refreshIntervalSeconds", 0)),
            schema=d.get("schema"),
            options=dict(d.get("options") or {}),
        )


@dataclass(frozen=True)
class MacroDef:
    """A SQL macro; `sql` is the text after "create or replace temporary function"."""

    sql: str
    name: str = ""

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> MacroDef:
        return cls(sql=d["sql"], name=d.get("name", ""))


@dataclass(frozen=True)
class MetricDef:
    """One metric.

    `order_by` names a column of the query that decides which row of a gauge is the last
    one; it is not a label. `quantiles` is "exact" or "sketch" for summaries. `stage`
    writes the query's rows once before an exact summary reads them several times, for
    queries that cost more to run again than to store.

    Instead of `sql` a metric may name a `source` (`from` in YAML), its rows (`where`), its labels
    (`by`, label to expression) and a `value`: an aggregate for a gauge, and an expression of the
    row otherwise. `each` makes a summary one of groups: its values are an aggregate for each
    group by these expressions, within the labels. `top` keeps the gauge's greatest values. Such
    metrics over one source share their scans.
    """

    kind: str
    name: str
    sql: str = ""
    help: str = ""
    enabled: bool = True
    buckets: tuple[float, ...] = ()
    objectives: tuple[float, ...] = ()
    order_by: str | None = None
    quantiles: str = "exact"
    stage: bool = False
    source: str | None = None
    where: str | None = None
    by: tuple[tuple[str, str], ...] = ()
    each: tuple[str, ...] = ()
    value: str | None = None
    top: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"metric {self.name}: unknown kind {self.kind!r}")
        if self.quantiles not in ("exact", "sketch"):
            raise ValueError(f"metric {self.name}: quantiles must be 'exact' or 'sketch'")
        if any(b >= c for b, c in zip(self.buckets, self.buckets[1:])):
            raise ValueError(f"metric {self.name}: buckets must strictly increase")
        if any(not 0 <= q <= 1 for q in self.objectives):
            raise ValueError(f"metric {self.name}: objectives must lie in [0, 1]")
        if self.source is None and (self.where or self.by or self.each or self.value or self.top):
            raise ValueError(f"metric {self.name}: where, by, each, value and top need a source instead of sql")
        if self.source is not None and self.sql:
            raise ValueError(f"metric {self.name}: either sql or a source")
        if self.source is not None and self.value is None and self.kind != "counter":
            raise ValueError(f"metric {self.name}: a {self.kind} of a source needs a value")
        if self.each and self.kind != "summary" or self.top is not None and self.kind != "gauge":
            raise ValueError(f"metric {self.name}: each is for summaries, top for gauges")

    @property
    def query(self) -> str:
        """The SQL of this metric's rows."""
        if self.source is None:
            return self.sql
        labels = [f"{e} as `{label}`" for label, e in self.by]
        rows = f"from {self.source}" + (f" where {self.where}" if self.where else "")
        value = f"{self.value or 0} as value"
        if self.each:
            groups = [f"{e} as each_{i}" for i, e in enumerate(self.each)]
            inner = f"select {', '.join([*labels, *groups, value])} {rows} group by all"
            return f"select {', '.join([*(f'`{label}`' for label, _ in self.by), 'value'])} from ({inner})"
        text = f"select {', '.join([*labels, value])} {rows}"
        if self.kind == "gauge":
            text += " group by all" if labels else ""
            if self.top is not None:
                text += f" order by {', '.join(['value desc', *(f'`{label}`' for label, _ in self.by)])} limit {self.top}"
        return text

    @classmethod
    def from_dict(cls, kind: str, d: Mapping[str, Any]) -> MetricDef:
        return cls(
            kind=kind,
            name=d["name"],
            sql=d.get("sql") or "" if "from" in d else d["sql"],
            help=d.get("help") or "",
            enabled=bool(d.get("enabled", True)),
            buckets=tuple(float(b) for b in d.get("buckets") or ()),
            objectives=tuple(float(o) for o in d.get("objectives") or ()),
            order_by=d.get("orderBy"),
            quantiles=d.get("quantiles", "exact"),
            stage=bool(d.get("stage", False)),
            source=d.get("from"),
            where=d.get("where"),
            by=tuple((str(k), str(v)) for k, v in (d.get("by") or {}).items()),
            each=(d["each"],) if isinstance(d.get("each"), str) else tuple(d.get("each") or ()),
            value=None if d.get("value") is None else str(d["value"]),
            top=None if d.get("top") is None else int(d["top"]),
        )


def metrics_from_dict(d: Mapping[str, Any] | None) -> tuple[MetricDef, ...]:
    """The four kinds of a `metrics:` block, in the order gauge, counter, summary, histogram."""
    d = d or {}
    return tuple(MetricDef.from_dict(k, m) for k in KINDS for m in d.get(k) or ())


def merge_metrics(*lists: Sequence[MetricDef]) -> tuple[MetricDef, ...]:
    """Append definition lists kind by kind, keeping each list's own order."""
    return tuple(m for k in KINDS for ms in lists for m in ms if m.kind == k)


@dataclass(frozen=True)
class Package:
    """A bundle of macros, sources and metrics under one name."""

    name: str
    version: str = ""
    variables: Mapping[str, Any] = field(default_factory=dict)
    macros: tuple[MacroDef, ...] = ()
    sources: tuple[SourceDef, ...] = ()
    metrics: tuple[MetricDef, ...] = ()
    prefix: str = ""

    @classmethod
    def from_dict(
        cls,
        d: Mapping[str, Any],
        variables: Mapping[str, Any] | None = None,
        prefix: str = "",
    ) -> Package:
        return cls(
            name=d["name"],
            version=str(d.get("version", "")),
            variables=dict(variables or d.get("variables") or {}),
            macros=tuple(MacroDef.from_dict(m) for m in d.get("macros") or ()),
            sources=tuple(SourceDef.from_dict(s) for s in d.get("sources") or ()),
            metrics=metrics_from_dict(d.get("metrics")),
            prefix=prefix,
        )

    @classmethod
    def from_yaml(cls, path: str, variables: Mapping[str, Any] | None = None, prefix: str = "") -> Package:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f), variables, prefix)


@dataclass(frozen=True)
class PackageRef:
    """A package file named by a config, with its variables and metric prefix."""

    package: str
    variables: Mapping[str, Any] = field(default_factory=dict)
    metric_prefix: str = ""

    def load(self, base_dir: str = "") -> Package:
        return Package.from_yaml(os.path.join(base_dir, self.package), self.variables, self.metric_prefix)


@dataclass(frozen=True)
class Config:
    """A run: its name, the labels every metric gets, package files, and its own definitions.

    `name` becomes a label on every sample, under the label name `instance_label`.
    """

    name: str = ""
    global_labels: Mapping[str, str] = field(default_factory=dict)
    packages: tuple[PackageRef, ...] = ()
    macros: tuple[MacroDef, ...] = ()
    sources: tuple[SourceDef, ...] = ()
    metrics: tuple[MetricDef, ...] = ()
    instance_label: str = "instance_name"

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> Config:
        labels = d.get("globalLabels") or {}
        if not isinstance(labels, Mapping):
            # a list of one-entry maps is accepted too; later entries win
            labels = {k: v for entry in labels for k, v in entry.items()}
        return cls(
            name=d.get("name") or "",
            global_labels={k: "" if v is None else str(v) for k, v in labels.items()},
            packages=tuple(
                PackageRef(p["package"], dict(p.get("variables") or {}), p.get("metricPrefix") or "")
                for p in d.get("packages") or ()
            ),
            macros=tuple(MacroDef.from_dict(m) for m in d.get("macros") or ()),
            sources=tuple(SourceDef.from_dict(s) for s in d.get("sources") or ()),
            metrics=metrics_from_dict(d.get("metrics")),
            instance_label=d.get("instanceLabel", "instance_name"),
        )

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    def labels(self) -> dict[str, str]:
        """The labels of this run; a value starting with `$` is read from the environment."""
        resolved = {
            k: os.environ.get(v[1:], "") if v.startswith("$") else v for k, v in self.global_labels.items()
        }
        return {self.instance_label: self.name, **resolved}

    def core_package(self) -> Package:
        """The config's own macros, sources and metrics, as a package without prefix."""
        return Package(name="core", version="1.0.0", macros=self.macros, sources=self.sources, metrics=self.metrics)
