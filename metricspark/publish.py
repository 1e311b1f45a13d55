"""Tables that are replaced as a whole, and read as a whole.

Every version is a folder of its own, written in full before an empty file with its name says so. Readers take the
version whose file comes last by name; nothing is ever renamed or written over, so stores without renames serve as
well. The newest `keep` versions stay for readers that have begun with them, older ones and what failed writers left
behind them are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Versions that stay for readers: a reader may be as many publications behind while it lists files.
KEEP = 8


class PublishedTable:
    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP) -> None:
        if keep < 1:
            raise ValueError("at least one version must stay")
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def publish(self, write: Callable[[str], Any], number: int | None = None) -> str:
        """Let `write` fill a new folder, then make it the newest version. Numbers go up by one unless given."""
        if number is None:
            number = (-1 if self.last_number is None else self.last_number) + 1
        name = f"{number:020d}-{uuid.uuid4().hex}"
        write(f"{self.path}/data/{name}")
        self._files("versions").create(self._at(f"versions/{name}"), False).close()
        self._sweep()
        return name

    def write(self, df: DataFrame, number: int | None = None) -> str:
        return self.publish(lambda folder: df.write.parquet(folder), number)

    def versions(self) -> list[str]:
        return self._names("versions")

    @property
    def last_number(self) -> int | None:
        versions = self.versions()
        return int(versions[-1].partition("-")[0]) if versions else None

    @property
    def folder(self) -> str:
        """The newest version's folder."""
        versions = self.versions()
        if not versions:
            raise ValueError(f"nothing has been published at {self.path}")
        return f"{self.path}/data/{versions[-1]}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def _sweep(self) -> None:
        """Remove all before the kept versions, each version's file first: no reader finds a name without its folder."""
        versions = self.versions()
        for name in versions[: -self.keep]:
            self._remove(f"versions/{name}")
        oldest = versions[-self.keep :][0]
        for name in self._names("data"):
            # a folder without a file may be a running writer's, if it comes after the oldest kept version
            if name < oldest:
                self._remove(f"data/{name}")

    def _at(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self, name: str) -> Any:
        return self._at(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        files, at = self._files(name), self._at(name)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def _remove(self, name: str) -> None:
        self._files(name).delete(self._at(name), True)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a published table."""
    return PublishedTable(spark, path).read()
