"""Metrics from SQL on Spark: sources, macros and metric queries in, one samples table out."""

from metricspark.defs import Config, MacroDef, MetricDef, Package, PackageRef, SourceDef
from metricspark.plans.exposition import render, write_text
from metricspark.plans.package import PackageRun, run_config, run_package, run_packages
from metricspark.publish import PublishedTable, read_published
from metricspark.session import prepare_session, remove_work
from metricspark.sources.incremental import IncrementalMetrics

__all__ = [
    "Config",
    "IncrementalMetrics",
    "MacroDef",
    "MetricDef",
    "Package",
    "PackageRef",
    "PackageRun",
    "PublishedTable",
    "SourceDef",
    "prepare_session",
    "read_published",
    "remove_work",
    "render",
    "run_config",
    "run_package",
    "run_packages",
    "write_text",
]
