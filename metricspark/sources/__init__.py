"""Sources: named relations the metric queries read."""

from metricspark.sources.read import read_source
from metricspark.sources.register import RefreshError, refresh_source, register_source, register_sources

__all__ = ["RefreshError", "read_source", "refresh_source", "register_source", "register_sources"]
