"""Packages to samples: macros, then sources, then every metric, as one samples table.

Metrics over the same query text, and metrics that name the same source, share an aggregation. The table is lazy but for
what reads rows in several passes: exact quantiles, and the shared groups of a source, which are made while a run is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from metricspark.defs import Config, MetricDef, Package
from metricspark.functions.macros import register_macros
from metricspark.operators.folds import SAMPLES_SCHEMA, check_labels, flat, fold_rows, summary_exact
from metricspark.operators.labels import full_name
from metricspark.operators.samples import Rows, to_rows
from metricspark.plans.fused import FusedMetrics
from metricspark.publish import PublishedTable
from metricspark.session import noting_checkpoints, prepare_session, remove_folders
from metricspark.sources.read import sql
from metricspark.sources.register import register_sources

# what a metric may fail with: a query that cannot be planned, labels that cannot be used, or data
FAILURES = (PySparkException, Py4JError, ValueError)

# a metric whose query could be planned: its rows, its definition and full name
Planned = tuple[Rows, MetricDef, str]

# Summaries and sources whose passes run at the same time.
PASSES_AT_ONCE = 8


@dataclass(frozen=True)
class Pending:
    """Metrics whose samples need jobs of their own to be planned. Should `build` fail, they are tried one by one."""

    names: tuple[str, ...]
    build: Callable[[], dict[str, DataFrame]]
    apart: Mapping[str, Callable[[], DataFrame]] = field(default_factory=dict)


@dataclass
class PackageRun:
    """What a run yields: one samples frame per query, and the errors of what had to be left out.

    Closing a run removes what its summaries keep in the shared folder; read or write the samples first.
    """

    spark: SparkSession
    parts: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    checkpoints: list[str] = field(default_factory=list)

    def __enter__(self) -> PackageRun:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.parts.clear()
        remove_folders(self.spark, self.checkpoints)
        self.checkpoints.clear()

    @property
    def samples(self) -> DataFrame:
        """All samples as one frame and one job; nothing runs before it is used."""
        return _union(list(self.parts.values())) or self.spark.createDataFrame([], SAMPLES_SCHEMA)

    @property
    def table(self) -> DataFrame:
        return flat(self.samples)

    def write(self, path: str) -> None:
        """Publish the samples at a path: readers (`read_published`) see the version before or this one, each whole.

        First as one job. If a metric fails on its data, the metrics are written one by one
        and only those that fail are left out, with their error noted.
        """
        table = PublishedTable(self.spark, path)
        try:
            table.write(self.samples)
        except FAILURES:
            table.publish(self._write_parts)

    def _write_parts(self, folder: str) -> None:
        self.spark.createDataFrame([], SAMPLES_SCHEMA).write.parquet(folder)
        for name, part in list(self.parts.items()):
            try:
                part.write.mode("append").parquet(folder)
            except FAILURES as e:
                self.errors[name] = str(e)
                del self.parts[name]


def _union(parts: Sequence[DataFrame]) -> DataFrame | None:
    """Parts of the same schema as one frame, halved so that the plan stays shallow."""
    if len(parts) < 2:
        return parts[0] if parts else None
    half = len(parts) // 2
    return _union(parts[:half]).union(_union(parts[half:]))


def named_metrics(
    package: Package, taken: Mapping[str, str] | None = None
) -> tuple[list[tuple[MetricDef, str]], dict[str, str]]:
    """Enabled metrics with their full names, and errors of those that are left out.

    A name used twice within a kind means its later definition. Over several kinds or packages the
    first registration stays; `taken` says which names are, and by what.
    """
    by_name: dict[tuple[str, str], MetricDef] = {}
    for m in package.metrics:
        if m.enabled:
            by_name[m.kind, full_name(package.prefix, package.name, m.name)] = m
    kept, errors = [], {}
    owners = dict(taken or {})
    for (kind, name), m in by_name.items():
        if name in owners:
            errors[f"{kind} {name} of {package.name}"] = f"the name is taken by {owners[name]}"
        else:
            owners[name] = f"a {kind} of {package.name}"
            kept.append((m, name))
    return kept, errors


def _query_key(m: MetricDef) -> tuple[str, str | None]:
    return m.query.strip().rstrip(";").strip(), m.order_by


def run_package(
    spark: SparkSession,
    package: Package,
    global_labels: Mapping[str, str] | None = None,
    now: float | None = None,
    taken: Mapping[str, str] | None = None,
) -> PackageRun:
    """Run one package. A metric that cannot be planned is noted in `errors`; the others go on.

    Every run starts from nothing: samples are a function of the sources as they are.
    """
    run, pending = _plan_package(spark, package, global_labels, now, taken)
    _finish(run, pending, global_labels)
    return run


def _plan_package(
    spark: SparkSession,
    package: Package,
    global_labels: Mapping[str, str] | None,
    now: float | None,
    taken: Mapping[str, str] | None,
) -> tuple[PackageRun, list[Pending]]:
    """A run with all that is lazy, and what is not."""
    prepare_session(spark)
    run = PackageRun(spark)
    register_macros(spark, package.macros)
    for source, error in register_sources(spark, package.sources, package.variables, now).items():
        run.errors[f"source {source}"] = error

    metrics, clashes = named_metrics(package, taken)
    run.errors.update(clashes)
    run.names = {name: f"a {m.kind} of {package.name}" for m, name in metrics}
    pending, fused = _fuse(spark, metrics, package.variables, global_labels)
    queries: dict[tuple[str, str | None], list[tuple[MetricDef, str]]] = {}
    for m, name in metrics:
        if name not in fused:
            queries.setdefault(_query_key(m), []).append((m, name))
    for (_, order_by), same in queries.items():
        try:
            rows = to_rows(sql(spark, same[0][0].query, package.variables), order_by, global_labels)
        except FAILURES as e:
            run.errors.update({name: str(e) for _, name in same})
            continue
        # metrics over the same query are folded together, so it is scanned and shuffled once
        folded = []
        for m, name in same:
            try:
                check_labels(m, [*rows.labels, *(global_labels or {})])
            except ValueError as e:
                run.errors[name] = str(e)
                continue
            if _is_ranked(m):
                x = (rows, m, name)
                pending.append(Pending((name,), lambda x=x: {x[2]: _apart(x, global_labels)}))
            else:
                folded.append((m, name))
        if folded:
            run.parts[" ".join(name for _, name in folded)] = fold_rows(rows, folded, global_labels)
    return run, pending


def _is_ranked(m: MetricDef) -> bool:
    return m.kind == "summary" and m.quantiles == "exact"


def _fuse(
    spark: SparkSession,
    metrics: Sequence[tuple[MetricDef, str]],
    variables: Mapping[str, object],
    global_labels: Mapping[str, str] | None,
) -> tuple[list[Pending], set[str]]:
    """Metrics that share a source, each source as one, and their names. Those with a label that a global one
    replaces are left apart, as their groups are of that label all the same; so are all of a source if they
    cannot be planned together."""
    sources: dict[str, list[tuple[MetricDef, str]]] = {}
    for m, name in metrics:
        if m.source is not None and not any(label in (global_labels or {}) for label, _ in m.by):
            sources.setdefault(m.source, []).append((m, name))
    pending, names = [], set()
    for source, some in sources.items():
        if len(some) < 2:
            continue
        try:
            for m, _ in some:
                check_labels(m, [*(label for label, _ in m.by), *(global_labels or {})])
            fused = FusedMetrics(spark, source, some, variables, global_labels)
            rows = spark.table(source)
        except FAILURES:
            continue

        def apart(named: tuple[MetricDef, str], source: str = source, rows: DataFrame = rows) -> DataFrame:
            # a later package may have another source of that name
            rows.createOrReplaceTempView(source)
            m, name = named
            return _apart((to_rows(sql(spark, m.query, variables), m.order_by, global_labels), m, name), global_labels)

        one_by_one = {name: lambda named=(m, name), apart=apart: apart(named) for m, name in some}
        pending.append(Pending(tuple(name for _, name in some), fused.build, one_by_one))
        names.update(name for _, name in some)
    return pending, names


def _apart(x: Planned, global_labels: Mapping[str, str] | None) -> DataFrame:
    """One metric by itself."""
    rows, m, name = x
    if _is_ranked(m):
        return summary_exact(rows, m, name, global_labels)
    return fold_rows(rows, [(m, name)], global_labels)


def _finish(run: PackageRun, pending: Sequence[Pending], global_labels: Mapping[str, str] | None) -> None:
    """Add what is pending to a run. It runs passes over its rows while it is built; side by side,
    the last tasks of one pass share the cluster with the next."""

    def build(item: Pending) -> tuple[dict[str, DataFrame], dict[str, str]]:
        parts: dict[str, DataFrame] = {}
        errors: dict[str, str] = {}
        with noting_checkpoints(run.checkpoints):
            try:
                return item.build(), errors
            except FAILURES as e:
                errors = {name: str(e) for name in item.names if name not in item.apart}
            for name, one in item.apart.items():
                try:
                    parts[name] = one()
                except FAILURES as e:
                    errors[name] = str(e)
        return parts, errors

    if pending:
        with ThreadPoolExecutor(min(len(pending), PASSES_AT_ONCE)) as pool:
            for parts, errors in pool.map(inheritable_thread_target(run.spark)(build), pending):
                run.parts.update(parts)
                run.errors.update(errors)


def run_packages(
    spark: SparkSession,
    packages: Iterable[Package],
    global_labels: Mapping[str, str] | None = None,
    now: float | None = None,
) -> PackageRun:
    """Run packages in order into one result. A package that cannot be set up is noted and left out.

    What needs jobs of its own is built at the end, of all packages together.
    """
    total, pending = PackageRun(spark), []
    for package in packages:
        try:
            run, more = _plan_package(spark, package, global_labels, now, total.names)
        except FAILURES as e:
            total.errors[f"package {package.name}"] = str(e)
            continue
        total.names.update(run.names)
        total.parts.update(run.parts)
        total.errors.update(run.errors)
        pending += more
    _finish(total, pending, global_labels)
    return total


def run_config(spark: SparkSession, config: Config, base_dir: str = "", now: float | None = None) -> PackageRun:
    """Run every package a config names, then its own definitions as the package `core`."""
    packages, errors = [], {}
    for ref in config.packages:
        try:
            packages.append(ref.load(base_dir))
        except (OSError, KeyError, ValueError) as e:
            errors[f"package {ref.package}"] = str(e)
    run = run_packages(spark, [*packages, config.core_package()], config.labels(), now)
    run.errors.update(errors)
    return run
