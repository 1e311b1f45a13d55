"""Sharding along a Hilbert curve: rows close in several metadata dimensions lie in the same files and shards.

Each dimension is quantised by the distribution of all its rows: rows are counted per cell of an ordered key - the
leading bits of a number's floating-point form, or the first bytes of a text beyond what all texts share - and cells
become up to 2**bits - 1 steps of about as many rows each. Counts of cells do not depend on the order of rows, so the
same table always gets the same steps. The steps are the coordinates of a point, whose place on the curve is the sort
key. Rows of one place are ordered by text and id, which puts equal texts side by side, and copies of a whole row by the
task that read them, so that no key is larger than what one task reads.

One range shuffle moves the rows, and they are written in curve order. The table's files are pieces of the curve: a
manifest with a row per file holds each file's rows, its first position and the span of every dimension. Shards are runs
of positions, cut so that their counts differ by one at most (`rows`) or so that bytes of text are near equal (`bytes`).
A scan with ranges of dimensions reads the files whose spans meet them.

Defined results: null is the first step of its dimension; NaN follows all numbers; a null text has size 1 and is the first
of its place; repeated rows take positions of their own; an empty table has no shards filled; columns with the names of
added ones are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark.llm import frames

SHARDS = 16
LAWS = ("rows", "bytes")
# Most bits of a coordinate; all of them together fill a 64-bit integer at most.
BITS = 8
# Leading bits of an ordered key that make a cell, which bounds the rows of a dimension's counts.
CELL_BITS = 20
# Bytes of text in a file, and files of the least number of them.
PIECE = 128 << 20
PIECES = 64
# Bytes of a text that make its key, and characters in which a common beginning is looked for.
KEY_BYTES = 7
PREFIX = 1024

# rows of a piece are numbered in the low bits of what monotonically_increasing_id returns
_ROW_BITS = 33


# -- curve -------------------------------------------------------------------------------------


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of every point, a row of coordinates below 2**bits.

    From the highest bit on, each level's quadrant turns and mirrors the lower bits of the first axis and swaps them
    with another's; what is left is a Gray code over the axes, whose bits are then interleaved.
    """
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(upper, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    place = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | (((axis ^ flip) >> level) & 1)
    return place


# -- quantisation ------------------------------------------------------------------------------


def _cells(values: pa.Array, prefix: int) -> np.ndarray:
    """The cell of each value, -1 for null: a larger value never has a smaller cell."""
    known = values.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        encoded = values.dictionary_encode()
        keys = [int.from_bytes(v.encode()[prefix : prefix + KEY_BYTES].ljust(KEY_BYTES, b"\0"), "big") for v in encoded.dictionary.to_pylist()]
        table = np.array([*keys, 0], np.int64) >> (8 * KEY_BYTES - CELL_BITS)
        return np.where(known, table[encoded.indices.fill_null(len(keys)).to_numpy()], -1)
    if pa.types.is_timestamp(values.type) or pa.types.is_date32(values.type):
        values = values.cast(pa.int64() if pa.types.is_timestamp(values.type) else pa.int32())
    numbers = pc.cast(values, pa.float64(), safe=False).fill_null(0.0).to_numpy(zero_copy_only=False).copy()
    numbers[numbers == 0] = 0.0  # minus zero is zero
    numbers[np.isnan(numbers)] = np.nan
    raw = numbers.view(np.int64)
    ordered = np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)
    return np.where(known, (ordered >> (64 - CELL_BITS)) + (1 << (CELL_BITS - 1)), -1)


def _counted(prefixes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells, counts = [], [], []
            for i, prefix in enumerate(prefixes):
                cell, n = np.unique(_cells(batch.column(i), prefix), return_counts=True)
                dims.append(np.full(len(cell), i, np.int32))
                cells.append(cell)
                counts.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (dims, cells, counts)], names=["dimension", "cell", "n"]
            )

    return run


def _steps(cells: list[tuple[int, int]], most: int) -> np.ndarray:
    """The first cells of up to `most` steps of about as many rows each; `cells` are (cell, rows) in order."""
    cell, n = np.array([c for c, _ in cells], np.int64), np.array([n for _, n in cells], np.int64)
    if not len(cell):
        return cell
    before = np.cumsum(n) - n
    step = before * most // n.sum()
    return cell[np.flatnonzero(np.diff(step, prepend=-1))]


@dataclass(frozen=True)
class Quantiser:
    """Steps of every dimension, small enough to travel with each task."""

    prefixes: list[int]
    steps: list[np.ndarray]
    bits: int

    def column(self, *dimensions: Column) -> Column:
        prefixes, steps, bits = self.prefixes, self.steps, self.bits

        def run(*columns: pa.Array) -> pa.Array:
            points = [np.searchsorted(s, _cells(c, p), "right") for c, p, s in zip(columns, prefixes, steps)]
            return pa.array(hilbert_index(np.stack(points, axis=1), bits), pa.int64())

        return F.arrow_udf(run, "bigint")(*dimensions)


def quantiser(rows: DataFrame, dimensions: tuple[str, ...], bits: int) -> Quantiser:
    texts = [d for d in dimensions if dict(rows.dtypes)[d] == "string"]
    prefixes = dict.fromkeys(dimensions, 0)
    if texts:
        start = {d: F.substring(d, 1, PREFIX) for d in texts}
        ends = rows.agg(*[f(c).alias(f"{n}_{d}") for d, c in start.items() for n, f in (("min", F.min), ("max", F.max))]).first()
        for d in texts:
            if ends[f"min_{d}"] is not None:
                prefixes[d] = len(os.path.commonprefix([ends[f"{n}_{d}"].encode() for n in ("min", "max")]))
    found = (
        rows.select(*dimensions)
        .mapInArrow(_counted(list(prefixes.values())), "dimension int, cell bigint, n bigint")
        .where("cell >= 0")
        .groupBy("dimension", "cell")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    cells: list[list[tuple[int, int]]] = [[] for _ in dimensions]
    for r in sorted(found):
        cells[r["dimension"]].append((r["cell"], r["n"]))
    return Quantiser(list(prefixes.values()), [_steps(c, (1 << bits) - 1) for c in cells], bits)


# -- layout ------------------------------------------------------------------------------------


@dataclass
class Layout:
    """Rows written in curve order, and what is known of each file."""

    written: DataFrame
    manifest: DataFrame  # piece, files, n, size, before, and min_ and max_ of each dimension
    dimensions: tuple[str, ...]

    def positions(self) -> DataFrame:
        """The written rows with their position along the curve."""
        piece = F.shiftright("__at", _ROW_BITS)
        first = self.manifest.select(F.col("piece").alias("__piece"), F.col("before").alias("__before"))
        at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        return self.written.withColumn("__piece", piece).join(first, "__piece").withColumn("position", at).drop("__piece", "__before")

    def cuts(self, shards: int, law: str) -> list[int]:
        """The first position of every shard but the first, and the number of rows."""
        if law not in LAWS:
            raise ValueError(f"{law!r} is none of {', '.join(LAWS)}")
        total = self.manifest.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
        n = total.n or 0
        if law == "rows" or not n:
            return [-(-k * n // shards) for k in range(1, shards + 1)]
        in_piece = Window.partitionBy("piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        files = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        sizes = self.manifest.select("piece", "before", F.coalesce(F.sum("size").over(files), F.lit(0)).alias("size_before"))
        rows = self.written.select("__at", "__size").withColumn("piece", F.shiftright("__at", _ROW_BITS))
        within = F.coalesce(F.sum("__size").over(in_piece), F.lit(0))
        placed = rows.withColumn("within", within).join(sizes, "piece")
        shard = F.floor((F.col("size_before") + F.col("within")).cast("decimal(38,0)") * shards / F.lit(total.size))
        position = F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        first = {r["shard"]: r["first"] for r in placed.groupBy(shard.cast("int").alias("shard")).agg(F.min(position).alias("first")).collect()}
        out, following = [], n
        for k in range(shards - 1, 0, -1):
            following = first.get(k, following)
            out.append(following)
        return [*out[::-1], n]

    def shards(self, shards: int = SHARDS, law: str = "rows") -> DataFrame:
        """All rows with `shard`, from 0, and `slot`, their gapless place in it, in curve order."""
        firsts = [0, *self.cuts(shards, law)[:-1]]
        known = F.array(*[F.lit(c).cast("bigint") for c in firsts])
        at = F.col("position")
        shard = F.size(F.filter(known, lambda c: c <= at)) - 1
        placed = self.positions().withColumn("shard", shard.cast("int"))
        return placed.withColumn("slot", at - F.element_at(known, F.col("shard") + 1)).drop("position", "__at", "__size")

    def shard(self, number: int, shards: int = SHARDS, law: str = "rows") -> DataFrame:
        """The rows of one shard, read from the files that hold any of it."""
        cuts = [0, *self.cuts(shards, law)]
        first, end = cuts[number], cuts[number + 1]
        files = self._files((F.col("before") < end) & (F.col("before") + F.col("n") > first))
        at = F.col("position")
        return Layout(files, self.manifest, self.dimensions).positions().where((at >= first) & (at < end)).drop("position", "__at", "__size")

    def scan(self, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
        """Rows whose dimensions lie in the given closed ranges, read from the files whose spans meet all of them."""
        meets, inside = F.lit(True), F.lit(True)
        for d, (low, high) in ranges.items():
            meets &= (F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high))
            inside &= F.col(d).between(F.lit(low), F.lit(high))
        return self._files(meets).where(inside).drop("__at", "__size")

    def _files(self, chosen: Column) -> DataFrame:
        """The written rows of some files; a row per chosen file comes to the driver, which has to name them to read them."""
        files = [file for r in self.manifest.where(chosen).select("files").collect() for file in r.files]
        spark = self.written.sparkSession
        return spark.read.schema(self.written.schema).parquet(*files) if files else self.written.where(F.lit(False))


def lay_out(
    docs: DataFrame,
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int | None = None,
    piece_bytes: int = PIECE,
    least_pieces: int = PIECES,
) -> Layout:
    """Write `docs` in curve order into the shared folder, as files of about `piece_bytes` of text."""
    bits = bits or max(1, min(BITS, 63 // len(dimensions)))
    docs = docs.drop("shard", "slot", "position")
    text = F.col(text_col).cast("string")
    steps = quantiser(docs, dimensions, bits)
    size = docs.agg(F.sum(F.octet_length(text).cast("bigint")).alias("bytes")).first().bytes or 0
    pieces = max(least_pieces, -(-size // piece_bytes))
    keyed = (
        docs.withColumn("curve", steps.column(*[F.col(d) for d in dimensions]))
        .withColumn("__text", F.xxhash64(text))
        .withColumn("__task", F.spark_partition_id())
        .withColumn("__size", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint"))
    )
    order = [F.col("curve"), F.col("__text"), F.col(id_col), F.col("__task")]
    in_order = keyed.repartitionByRange(pieces, *order).sortWithinPartitions(*order).drop("__text", "__task")
    written = frames.stage(in_order.withColumn("__at", F.monotonically_increasing_id()), "curve")
    spans = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    by_piece = written.withColumn("__file", F.col("_metadata.file_path")).groupBy(F.shiftright("__at", _ROW_BITS).alias("piece"))
    files = by_piece.agg(
        F.collect_set("__file").alias("files"), F.count(F.lit(1)).alias("n"), F.sum("__size").alias("size"), *spans
    )
    before = F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    # a row per file, put in order in one task
    manifest = frames.stage(files.withColumn("before", F.coalesce(before, F.lit(0))), "manifest")
    return Layout(written, manifest, dimensions)
