"""Session settings and the shared folder for snapshots, checkpoints and streaming state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def prepare_session(spark: SparkSession) -> SparkSession:
    """Set what results depend on: label texts of timestamps are written in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="metricspark-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder that belongs to this application."""
    return "/".join((shared_dir(spark), spark.sparkContext.applicationId, *parts))


def new_work_path(spark: SparkSession, purpose: str) -> str:
    return work_path(spark, purpose, uuid.uuid4().hex)


# where this thread notes the checkpoints it writes
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting_checkpoints(paths: list[str]) -> Iterator[None]:
    """Append the paths of the checkpoints that this thread writes meanwhile, for their removal."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def settle(df: DataFrame) -> DataFrame:
    """Compute now and keep the result in the shared folder, where lost executors cannot take it."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    noted = _noted.get()
    if noted is not None:
        noted.append(kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return kept


def remove_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_work(spark: SparkSession) -> None:
    """Remove all that this application keeps in the shared folder - snapshots, stages, checkpoints, streams - when it
    is about to end. What it has published elsewhere stays."""
    paths = [work_path(spark)]
    own = spark.sparkContext.getCheckpointDir()
    if own is not None:
        # the context's own folder of checkpoints, below the one that was set
        paths.append(own)
    remove_folders(spark, paths)
