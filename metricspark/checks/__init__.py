"""Registered queries over the given tables, with SQL twins."""

from metricspark.checks import catalog, enriching, folding, reading, sampling, shapes, streams  # noqa: F401
from metricspark.checks.harness import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
