"""Arrow IPC files.

Files are listed by Spark and opened on the executors, so nothing but paths is moved before the
batches are read. A file in the random access format is split by record batches, which keeps
one large file from ending up in one task; a file in the stream format is read from its start,
one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    import pyarrow as pa

# Fixed value: the first bytes of a file in the random access format.
FILE_MAGIC = b"ARROW1"

WHOLE_FILE = -1


def _tasks(schema: pa.Schema):
    """The two steps that run in tasks. They hold all they need, so executors need no import of this module."""
    import pyarrow as pa
    from pyarrow import fs

    def open_path(path: str):
        where, inner = fs.FileSystem.from_uri(path)
        return where.open_input_file(inner)

    def list_batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Path to (path, batch number) rows."""
        for chunk in files:
            for path in chunk.column("path").to_pylist():
                with open_path(path) as f:
                    is_file = f.read(len(FILE_MAGIC)) == FILE_MAGIC
                    f.seek(0)
                    numbers = list(range(pa.ipc.open_file(f).num_record_batches)) if is_file else [WHOLE_FILE]
                yield pa.RecordBatch.from_pydict(
                    {"path": pa.array([path] * len(numbers), pa.string()), "batch": pa.array(numbers, pa.int64())}
                )

    def as_declared(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(f.name).cast(f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def read_batches(splits: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in splits:
            for path, number in zip(chunk.column("path").to_pylist(), chunk.column("batch").to_pylist()):
                with open_path(path) as f:
                    if number == WHOLE_FILE:
                        for batch in pa.ipc.open_stream(f):
                            yield as_declared(batch)
                    else:
                        yield as_declared(pa.ipc.open_file(f).get_batch(number))

    return list_batches, read_batches


def read_arrow(spark: SparkSession, path: str, schema: str | StructType | None) -> DataFrame:
    """Arrow IPC files under a path or glob, read as the given schema."""
    if schema is None:
        raise ValueError("an arrow source needs a schema")
    # pyarrow is needed for these sources only
    from pyspark.sql.pandas.types import to_arrow_schema

    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    list_batches, read_batches = _tasks(to_arrow_schema(declared))
    files = spark.read.format("binaryFile").load(path).select("path")
    splits = files.mapInArrow(list_batches, "path string, batch long")
    # neighbouring batches of a large file go to different tasks; the number is given, as adaptive
    # execution would otherwise merge the few bytes of paths into one task
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = splits.repartition(tasks, F.col("path"), F.col("batch"))
    return spread.mapInArrow(read_batches, declared)
