"""Line dedup over levelled sorted runs of line hashes.

Every long line of a document becomes a 128-bit key. Keys arrive in batches, as crawls do. The store
is a set of runs: tables bucketed and sorted by key, each row with the number of documents and the
largest id that hold the line. A batch is aggregated by key, merge-anti-joined with every run - a key
that some run already has in enough documents up to an id as large adds nothing more - and what is
left becomes a new run of level 0. When a level has `fan` runs, they are merged into one run of the
next level. All runs share one bucketing, so the joins read them without moving them; a line that a third of all documents share is one row per task before any shuffle.

Afterwards a line with keys in `min_docs` documents or more is dropped everywhere but in the document
of the largest id that holds it.

Defined results: a null or empty text is one empty line; rows of the same id are one document, and keep or lose a line
together; rows without an id are no documents that count, and lose a line that enough documents hold; a text whose lines
all go becomes empty; texts are split only at \\n; other columns pass through unless they are named like the added ones,
which replace them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.llm import frames
from metricspark.session import new_work_path, remove_folders

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 5
FAN = 4
# Bytes of a key with its count and id, and of what a bucket holds of them at most on average.
KEY_BYTES = 64
BUCKET = 64 << 20
LEAST_BUCKETS = 12

# fixed values: the white space that is stripped from lines, [\x20\x09-\x0D]
STRIPPED = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a UTF-8 line, None if it is too short to count. bytes.lower() changes A-Z only."""
    line = line.strip(STRIPPED).lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def _keys_of(min_chars: int):
    """(id, key) for every different key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, 1):
            at, keys = [], []
            for i, text in enumerate(batch.column(1)):
                if text.is_valid:
                    found = {line_key(line, min_chars) for line in text.as_py().split(b"\n")} - {None}
                    keys.extend(sorted(found))
                    at.extend([i] * len(found))
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary())], names=["id", "key"])

    return run


class LineRuns:
    """The store: runs by level, bucketed and sorted by key in the shared folder."""

    def __init__(self, spark: SparkSession, keys: int, min_docs: int = MIN_DOCS, fan: int = FAN):
        """`keys` is the number of rows to come, of which the number of buckets is made."""
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.buckets = max(LEAST_BUCKETS, -(-keys * KEY_BYTES // BUCKET))
        self.levels: list[list[tuple[str, str]]] = []  # of each run, its table and its folder

    def _runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", new_work_path(self.spark, "line_runs")
        (
            rows.repartition(self.buckets, "key")
            .write.bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", path)
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fan:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._total(merged), level + 1)
            self._drop(merged)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"drop table {name}")
        remove_folders(self.spark, [path for _, path in runs])

    def close(self) -> None:
        """Remove all runs."""
        self._drop(self._runs())
        self.levels = []

    def _total(self, runs: list[tuple[str, str]]) -> DataFrame:
        # read as plain files: a union of bucketed tables counts as partitioned by key, but its columnar
        # form only strings their partitions together, and equal keys of two runs would stay apart
        schema = self.spark.table(runs[0][0]).schema
        rows = self.spark.read.schema(schema).parquet(*(path for _, path in runs))
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (id, key). All rows of an id are in one batch, so each document counts once."""
        batch = keys.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
        for name, _ in self._runs():
            run = self.spark.table(name).where(F.col("n") >= self.min_docs).select("key", F.col("last").alias("seen"))
            settled = (batch["key"] == run["key"]) & (run["seen"] >= F.coalesce(batch["last"], run["seen"]))
            batch = batch.join(run, settled, "left_anti")
        self._write(batch, 0)

    def repeated(self) -> DataFrame:
        """Keys found in at least `min_docs` documents, with the largest id that holds each."""
        return self._total(self._runs()).where(F.col("n") >= self.min_docs).select("key", "last")


def _kept(min_chars: int):
    """Per row the text without its lines of the given keys, and how many went; null keys change nothing."""

    def cut(text: str | None, gone: set[bytes]) -> tuple[str, int]:
        lines = (text or "").encode().split(b"\n")
        rest = [line for line in lines if line_key(line, min_chars) not in gone]
        return b"\n".join(rest).decode(), len(lines) - len(rest)

    def run(text: pa.Array, keys: pa.Array) -> pa.Array:
        done = ((None, 0) if not k.is_valid else cut(t.as_py(), set(k.as_py())) for t, k in zip(text, keys))
        kept, dropped = zip(*done) if len(text) else ((), ())
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(dropped, pa.int64())], names=["text", "n"]
        )

    return run


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fan: int = FAN,
) -> DataFrame:
    """`docs` with repeated lines taken out of the text, and the columns n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    keys = frames.stage(
        given.mapInArrow(_keys_of(min_chars), f"id {id_type}, key binary").withColumn(
            "batch", F.pmod(F.xxhash64("id"), F.lit(batches))
        ),
        "line_keys",
        "batch",
    )
    runs = LineRuns(spark, keys.count(), min_docs, fan)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).select("id", "key"))
    # a table of its own, so that the join can split a key that very many documents hold
    repeated = frames.stage(runs.repeated(), "repeated_lines")
    runs.close()
    gone = (
        keys.join(repeated, "key")
        .where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy(F.col("id").alias("__id"))
        .agg(F.collect_set("key").alias("__keys"))
    )
    cut = F.arrow_udf(_kept(min_chars), "text string, n bigint")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    joined = docs.drop("n_lines", "n_dropped").join(gone, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return (
        joined.withColumn("__cut", cut(F.when(F.col("__keys").isNotNull(), text), F.col("__keys")))
        .withColumn("n_lines", lines.cast("long"))
        .withColumn("n_dropped", F.coalesce(F.col("__cut.n"), F.lit(0).cast("long")))
        .withColumn(text_col, F.coalesce(F.col("__cut.text"), text))
        .drop("__id", "__keys", "__cut")
    )
