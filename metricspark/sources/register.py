"""Sources as temporary views, and snapshots of the materialized ones.

A view is defined anew for every run, so it sees the files that exist then. A materialized
source is written to the shared folder and read from there: every metric scans the same
snapshot, in a columnar layout, and a lost executor cannot change it. Two folders are used in
turn, so queries that still read the previous snapshot are not disturbed by a refresh.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from metricspark.defs import SourceDef
from metricspark.session import work_path
from metricspark.sources.read import read_source


class RefreshError(RuntimeError):
    """A refresh failed; the previous snapshot is still in place."""


@dataclass
class _Snapshot:
    turn: int
    taken_at: float


# what this driver has written, by application and the folder of the source
_snapshots: dict[tuple[str, str], _Snapshot] = {}


def _folder(d: SourceDef, variables: Mapping[str, Any] | None) -> str:
    """A folder per definition: a changed definition, or another of the same name, is another snapshot."""
    text = repr((d, sorted((variables or {}).items())))
    return f"{d.name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def _show(spark: SparkSession, d: SourceDef, folder: str, turn: int) -> None:
    path = work_path(spark, "snapshots", folder, str(turn % 2))
    spark.read.parquet(path).createOrReplaceTempView(d.name)


def refresh_source(
    spark: SparkSession, d: SourceDef, variables: Mapping[str, Any] | None = None, now: float | None = None
) -> None:
    """Replace the view of a source; a materialized one is computed and written first."""
    if not d.materialize:
        read_source(spark, d, variables).createOrReplaceTempView(d.name)
        return
    folder = _folder(d, variables)
    key = (spark.sparkContext.applicationId, folder)
    previous = _snapshots.get(key)
    turn = 0 if previous is None else previous.turn + 1
    try:
        path = work_path(spark, "snapshots", folder, str(turn % 2))
        read_source(spark, d, variables).write.mode("overwrite").parquet(path)
        _show(spark, d, folder, turn)
    except Exception as e:
        if previous is None:
            raise
        _show(spark, d, folder, previous.turn)
        raise RefreshError(f"source {d.name}: {e}") from e
    _snapshots[key] = _Snapshot(turn, time.time() if now is None else now)


def register_source(
    spark: SparkSession, d: SourceDef, variables: Mapping[str, Any] | None = None, now: float | None = None
) -> str | None:
    """Make a source ready for a run.

    A snapshot is taken once, and again when it is older than its refresh interval. The error of
    a failed refresh is returned, not raised: the run goes on with the snapshot it has.
    """
    now = time.time() if now is None else now
    folder = _folder(d, variables)
    current = _snapshots.get((spark.sparkContext.applicationId, folder))
    if not d.materialize or current is None:
        refresh_source(spark, d, variables, now)
        return None
    interval = d.refresh_interval_seconds
    if 0 < interval <= now - current.taken_at:
        try:
            refresh_source(spark, d, variables, now)
        except RefreshError as e:
            return str(e)
    else:
        _show(spark, d, folder, current.turn)
    return None


def register_sources(
    spark: SparkSession,
    defs: Iterable[SourceDef],
    variables: Mapping[str, Any] | None = None,
    now: float | None = None,
) -> dict[str, str]:
    """In order, so that a source may read earlier ones; stops at the first that cannot be read."""
    errors = {}
    for d in defs:
        error = register_source(spark, d, variables, now)
        if error is not None:
            errors[d.name] = error
    return errors


def forget_snapshots(spark: SparkSession) -> None:
    """Take every materialized source anew at its next registration."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _snapshots if k[0] == app]:
        del _snapshots[key]
