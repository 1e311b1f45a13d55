"""Packages that come with the engine, over the driver's tables registered as views."""

from __future__ import annotations

import os
from dataclasses import replace

from metricspark.defs import Package

NAMES = ("activity", "deliveries", "sales")


def load(name: str, materialize: bool | None = None) -> Package:
    """A shipped package; `materialize` overrides whether its sources are snapshots or views."""
    package = Package.from_yaml(os.path.join(os.path.dirname(__file__), f"{name}.yml"))
    if materialize is None:
        return package
    return replace(package, sources=tuple(replace(s, materialize=materialize) for s in package.sources))
