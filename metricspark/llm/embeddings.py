"""Exact metric range join of embeddings: all pairs of at least a given cosine, without comparing all.

Equal vectors travel as one row. Unit vectors at a cosine of t are at an angle of acos(t), so the join
is a range join in a metric space. Pivots, some of the vectors, partition the rest: each is at home in
the cell of its nearest pivot, and the homes of a cell are written once, in blocks of bounded size. Two
cells meet if by the triangle inequality, from the angle between their pivots and the radii of their
blocks, a vector of one could be near one of the other. No vector is copied for that: a task holds a
group of blocks, reads the blocks of another group from the shared folder one after the other, and lets
in as guests those vectors that the triangle inequality allows near one of the strips into which the
block at home is divided, by pivots of its own. Homes and guests are compared on some principal
directions and the lengths of what is left, which bound the cosine from above, and what passes that is
compared in full. So each pair meets exactly once, which vectors serve as pivots changes the amount of
work only, and the disk holds each vector a fixed number of times, however many meet. No pairs leave a
task: it gives each vector its number of links, and hangs it on one vector it is connected with there.

Vectors spread evenly over many dimensions are near the border of most cells. Then a fixed part of all
pairs is compared, and the time grows with the square of their number; clustered ones are not.

Defined results: a vector that is null, empty, zero, or holds nulls or anything not finite links with
nothing; vectors of different lengths do not link; rows that repeat an id are vectors of their own, whose
smallest id names a component; a null id is larger than any other and never kept.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.llm import frames
from metricspark.llm.warc import opened
from metricspark.session import new_work_path, remove_folders

COSINE = 0.9
# Vectors a cell has on average, until there are MOST_PIVOTS cells or they weigh PIVOT_BYTES.
CELL = 4096
MOST_PIVOTS = 4096
PIVOT_BYTES = 16 << 20
# Vectors of a block, and their bytes.
BLOCK = 4096
BLOCK_BYTES = 4 << 20
# What a task holds of one side, and at once of the other; small tables are dealt into PARTS groups all the same.
GROUP_BYTES, GROUP = 16 << 20, 1 << 16
PANEL = 8192
PARTS, PART_BYTES = 16, 1 << 18
MOST_TASKS = 2048
# Vectors of a strip, and links that are counted at once.
STRIP = 128
LINKS = 1 << 18
# Vectors that principal directions are taken from. What comparing a pair on one direction costs is 1, and so much more any
# pair, and one that passes.
SAMPLE = 512
FIXED, PASSED = 15, 20_000
# Keys that a task remembers to find repeated vectors.
SEEN = 1 << 16
# Widens the bounds against rounding; the comparison itself is exact.
SLACK = 1e-9
# Unit vectors in whole numbers: sums of their products are exact in doubles, so the nearest pivot of equal vectors is
# the same whatever they are multiplied with.
WHOLE = 1 << 24


class Block(NamedTuple):
    size: int
    cell: int
    n: int
    near: float  # the least cosine with the cell's pivot
    file: str
    at: int


class Space(NamedTuple):
    """What tasks know of the vectors of one length: pivots, and some orthogonal directions or none."""

    pivots: np.ndarray
    basis: np.ndarray | None


def _slack(n: int) -> float:
    """More than the rounding of a dot product of n terms in single precision."""
    return (n + 8) * 1.2e-7


def _usable(dtype: type):
    """(id, key, vec): vectors as bytes of floats or doubles, null where they link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)  # no negative zeros
            at = lists.offsets.to_numpy()
            odd, some = (np.concatenate([[0], np.cumsum(v)])[at] for v in (~np.isfinite(x), x != 0))
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(odd) == 0) & (np.diff(some) > 0)
            data, at = x.tobytes(), (at * x.itemsize).tolist()
            vectors = [data[at[i] : at[i + 1]] if g else None for i, g in enumerate(good.tolist())]
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "key", "vec"]
            )

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(vectors: list[bytes], dtype: type) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1))


def _by_length(vectors: list[bytes]) -> dict[int, np.ndarray]:
    lengths = np.array([len(v) for v in vectors])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def _basis(x: np.ndarray, cosine: float) -> np.ndarray | None:
    """The principal directions of unit vectors by which pairs are told apart at the least cost; None for all directions.

    Half of the vectors gives the directions, the other half shows how many of the pairs pass that do not link."""
    half = min(len(x) // 2, SAMPLE)
    if half < 32:
        return None
    directions, x = np.linalg.svd(x[:half], full_matrices=False)[2], x[half : 2 * half]
    links = np.count_nonzero(x @ x.T >= cosine)
    best, least = None, FIXED + x.shape[1]
    for k in range(8, min(len(directions), x.shape[1] - 1), 4):
        p, rest = _split(x, directions[:k])
        passed = np.count_nonzero(p @ p.T + rest * rest.T >= cosine) - links
        if (cost := FIXED + k + PASSED * passed / len(x) ** 2) < least:
            best, least = directions[:k], cost
    return best


def _split(unit: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors on a basis, and the lengths of what is left of them."""
    p = unit @ basis.T
    return p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1, keepdims=True)))


def _homes(held, dtype: type):
    """Vectors with the cell of their nearest pivot and their cosine with it; cell 0 where no pivot has their length.

    A vector that comes again to a task is only counted, and the count is sent without the vector."""
    names = ["key", "copies", "vec", "size", "cell", "near"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64()]

    def batch_of(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=names)

    def again(seen: dict[bytes, list]) -> pa.RecordBatch:
        more = [(key, n, size, cell) for key, (n, size, cell) in seen.items() if n]
        keys, counts, sizes, cells = zip(*more) if more else ([], [], [], [])
        return batch_of(keys, counts, [None] * len(more), sizes, cells, [None] * len(more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {n: np.rint(space.pivots * WHOLE).T for n, space in held.value.items()}
        seen: dict[bytes, list] = {}
        for batch in batches:
            if len(seen) >= SEEN:
                yield again(seen)
                seen.clear()
            keys, vectors = [], []
            for key, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in seen:
                    seen[key][0] += 1
                else:
                    seen[key] = [0, len(vec), 0]
                    keys.append(key)
                    vectors.append(vec)
            cell, near = np.zeros(len(keys), np.int32), np.full(len(keys), -1.0)
            for n, rows in _by_length(vectors).items():
                if n in whole:
                    for some in np.array_split(rows, -(-len(rows) // 1024)):
                        d = np.rint(_stack([vectors[i] for i in some], dtype) * WHOLE) @ whole[n]
                        cell[some], near[some] = d.argmax(axis=1), d.max(axis=1) / WHOLE**2
            for key, c in zip(keys, cell.tolist()):
                seen[key][2] = c
            yield batch_of(keys, np.ones(len(keys), np.int64), vectors, [len(v) for v in vectors], cell, near)
        yield again(seen)

    return run


def _pack(folder: str):
    """Write the homes of each slice of a cell, which come in the order of their keys, as one block: keys, copies, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        file, at, stream = f"{uuid.uuid4().hex}.blocks", 0, None
        written: list[Block] = []
        place, keys, copies, vectors, near = None, [], [], [], 1.0

        def end() -> None:
            nonlocal at, stream
            if keys:
                stream = stream or fs.open_output_stream(f"{path}/{file}", compression=None)
                data = b"".join(keys) + np.array(copies, np.int64).tobytes() + b"".join(vectors)
                stream.write(data)
                written.append(Block(place[0], place[1], len(keys), near, file, at))
                at += len(data)

        for batch in batches:
            size, cell, part, key, count, vec, close = (batch.column(i).to_pylist() for i in range(7))
            for i, here in enumerate(zip(size, cell, part)):
                if here != place:
                    end()
                    place, keys, copies, vectors, near = here, [], [], [], 1.0
                if keys and key[i] == keys[-1]:
                    copies[-1] += count[i]
                    vectors[-1] = vectors[-1] or vec[i]
                else:
                    keys.append(key[i])
                    copies.append(count[i])
                    vectors.append(vec[i])
                near = near if close[i] is None else min(near, close[i])
        end()
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_pylist(
            [b._asdict() for b in written],
            pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("n", pa.int32()), ("near", pa.float64()), ("file", pa.string()), ("at", pa.int64())]),
        )

    return run


class Rows:
    """Blocks in memory: keys and copies of their vectors, these as unit vectors, and what bounds their cosines."""

    def __init__(self, fs, path: str, blocks: list[Block], space: Space | None, dtype: type):
        keys, copies, unit = [], [], []
        for b in blocks:
            with fs.open_input_file(f"{path}/{b.file}") as f:
                data = f.read_at(b.n * (24 + b.size), b.at)
            keys.append(np.frombuffer(data, np.uint8, b.n * 16).reshape(b.n, 16))
            copies.append(np.frombuffer(data, np.int64, b.n, b.n * 16))
            unit.append(_unit(np.frombuffer(data, dtype, offset=b.n * 24).reshape(b.n, -1)))
        self.blocks, self.starts = blocks, np.concatenate([[0], np.cumsum([b.n for b in blocks])]).tolist()
        self.keys, self.copies, self.unit = np.concatenate(keys), np.concatenate(copies).astype(np.float64), np.concatenate(unit)
        self.short = self.bound = self.unit.astype(np.float32)
        if space is not None and space.basis is not None:
            self.bound = np.concatenate(_split(self.unit, space.basis), axis=1).astype(np.float32)

    def order(self, rows: np.ndarray) -> None:
        whole = self.bound is self.short
        self.keys, self.copies, self.unit, self.short = (x[rows] for x in (self.keys, self.copies, self.unit, self.short))
        self.bound = self.short if whole else self.bound[rows]

    def part(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.unit[start:stop], self.short[start:stop], self.bound[start:stop]


def _strips(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, float]]]:
    """An order of the vectors of a block, its pivots, and strips of the order: start, stop, their pivot, and the least
    cosine with it of a vector that could be near one of the strip."""
    n = len(x)
    pivots = x[: -(-n // STRIP)]
    for _ in range(2):
        nearest = (x @ pivots.T).argmax(axis=1)
        sums = (nearest == np.arange(len(pivots))[:, None]).astype(np.float32) @ x
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > 1e-3, sums / np.maximum(length, 1e-3), pivots)
    d = x @ pivots.T
    nearest, near = d.argmax(axis=1), d.max(axis=1)
    order = np.lexsort((-near, nearest))
    ends = np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(pivots)))]).tolist()
    strips, slack = [], _slack(x.shape[1])
    for p in range(len(pivots)):
        for some in np.array_split(np.arange(ends[p], ends[p + 1]), -(-(ends[p + 1] - ends[p]) // STRIP) or 1):
            if len(some):
                angle = math.acos(max(-1.0, min(1.0, float(near[order[some[-1]]]) - slack))) + reach
                strips.append((int(some[0]), int(some[-1]) + 1, p, math.cos(min(math.pi, angle)) - slack))
    return order, pivots, strips


class Links:
    """The numbers of links of rows, and for each the smallest row that it is known to be connected with."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.count, self.root = copies, np.zeros(len(copies)), np.arange(len(copies))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.n += len(i)
        if self.n >= LINKS:
            self.settle()

    def add_matrix(self, link: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Links between all rows of i and of j that `link` names."""
        self.count[i] += link @ self.copies[j]
        self.count[j] += self.copies[i] @ link
        while (apart := link & (self.root[i][:, None] != self.root[j][None])).any():
            a, b = np.nonzero(apart)
            self._join(i[a], j[b])

    def settle(self) -> None:
        if self.held:
            i, j = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.n = [], 0
            for a, b in ((i, j), (j, i)):
                self.count += np.bincount(a, weights=self.copies[b], minlength=len(self.count))
            self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while ((up := root[root]) != root).any():
                root[:] = up


def _places(x: np.ndarray) -> np.ndarray:
    """Where an array of truth values holds, if it seldom does; its length is a multiple of eight."""
    eights = np.flatnonzero(x.view(np.uint64) != 0)
    at = np.flatnonzero(x.reshape(-1, 8)[eights])
    return eights[at >> 3] * 8 + (at & 7)


def _compare(left: Rows, strips: list, right: Rows, start: int, stop: int, shift: int, cosine: float, links: Links) -> None:
    """Compare the strips of the left side with a panel of the right one, whose rows are `shift` more in `links`; only
    pairs whose second row has the larger number count, as a side meets itself too."""
    unit, short, bound = right.part(start, stop)
    least = np.float32(cosine - _slack(bound.shape[1]))
    room, passed = np.empty(len(short) * STRIP, np.float32), np.zeros(-(-len(short) * STRIP // 8) * 8, bool)
    for pivots, parts in strips:
        if not parts or parts[0][0] >= stop + shift:
            continue
        reached = pivots @ short.T
        for lo, hi, p, near in parts:
            guests = np.flatnonzero(reached[p] >= near)
            if not len(guests):
                continue
            all_of_them = len(guests) > 0.9 * len(short)
            some = bound if all_of_them else bound.take(guests, axis=0)
            n, width = len(some) * (hi - lo), hi - lo
            np.matmul(some, left.bound[lo:hi].T, out=room[:n].reshape(-1, width))
            passed[n : n + 8] = False
            np.greater_equal(room[:n], least, out=passed[:n])
            found = _places(passed[: -(-n // 8) * 8])
            if not len(found):
                continue
            j, i = np.divmod(found, width)
            i, j = i + lo, j if all_of_them else guests[j]
            later = j + start + shift > i
            if not later.all():
                i, j = i[later], j[later]
            if len(i) > 4096:
                rows, columns = np.unique(i), np.unique(j)
                if len(i) * 16 > len(rows) * len(columns):
                    link = left.unit[rows] @ unit[columns].T >= cosine
                    link &= columns[None] + start + shift > rows[:, None]
                    links.add_matrix(link, rows, columns + start + shift)
                    continue
            for at in range(0, len(i), 4096):
                a, b = i[at : at + 4096], j[at : at + 4096]
                near_by = np.einsum("nd,nd->n", left.unit[a], unit[b]) >= cosine
                links.add(a[near_by], b[near_by] + start + shift)


def _meet(held, plan, folder: str, cosine: float, dtype: type):
    """Number of a task -> the vectors of its groups that link there, with their numbers of links and one vector each that
    they are connected with."""
    reach = math.acos(max(-1.0, min(1.0, cosine - SLACK)))

    def angle(cosine: np.ndarray, size: int) -> np.ndarray:
        return np.arccos(np.clip(cosine - _slack(size), -1, 1))

    def meets(space: Space | None, left: list[Block], right: list[Block]) -> np.ndarray:
        """Which blocks on the right could hold a partner of which on the left."""
        if space is None:
            return np.ones((len(left), len(right)), bool)
        a, b = (space.pivots[[x.cell for x in side]] for side in (left, right))
        radii = [angle(np.array([x.near for x in side]), a.shape[1]) for side in (left, right)]
        between = np.arccos(np.clip(a @ b.T + SLACK, -1, 1))
        return between <= radii[0][:, None] + radii[1][None] + reach + SLACK

    def batches_of(rows: Rows, links: Links, first: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(links.count[first : first + len(rows.keys)] > 0) + first
        binary = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
        for some in np.array_split(found, -(-len(found) // 8192) or 1):
            if len(some):
                counts = pa.array(np.rint(links.count[some]).astype(np.int64))
                columns = [binary(keys[some]), counts, binary(keys[links.root[some]])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        groups, tasks = plan.value
        for task in (t for batch in batches for t in batch.column(0).to_pylist()):
            at, others = tasks[task]
            blocks = groups[at]
            space = held.value.get(blocks[0].size)
            left = Rows(fs, path, blocks, space, dtype)
            strips, order = [], []
            for first, last in zip(left.starts, left.starts[1:]):
                rows, pivots, parts = _strips(left.short[first:last], reach)
                order.append(rows + first)
                strips.append((pivots, [(lo + first, hi + first, p, near) for lo, hi, p, near in parts]))
            left.order(np.concatenate(order))
            n = len(left.keys)
            own = Links(left.copies)
            for other in others:
                met = meets(space, blocks, groups[other])
                if other == at:
                    for start, stop in _panels(blocks):
                        some = met[:, start:stop].any(axis=1)
                        _compare(left, [s for s, m in zip(strips, some) if m], left, left.starts[start], left.starts[stop], 0, cosine, own)
                    own.settle()
                    continue
                near = [b for b, m in zip(groups[other], met.any(axis=0)) if m]
                met = met[:, met.any(axis=0)]
                for start, stop in _panels(near):
                    right = Rows(fs, path, near[start:stop], space, dtype)
                    links = Links(np.concatenate([left.copies, right.copies]))
                    links.root[:n] = own.root
                    some = met[:, start:stop].any(axis=1)
                    _compare(left, [s for s, m in zip(strips, some) if m], right, 0, len(right.keys), n, cosine, links)
                    links.settle()
                    own.count += links.count[:n]
                    own.root = links.root[:n]
                    yield from batches_of(right, links, n, np.concatenate([left.keys, right.keys]))
            yield from batches_of(left, own, 0, left.keys)

    return run


def _panels(blocks: list[Block]) -> Iterator[tuple[int, int]]:
    """Runs of blocks, as (start, stop), that hold PANEL vectors or GROUP_BYTES at most, or are one block."""
    start, n, size = 0, 0, 0
    for i, b in enumerate(blocks):
        if i > start and (n + b.n > PANEL or size + b.n * b.size > GROUP_BYTES):
            yield start, i
            start, n, size = i, 0, 0
        n, size = n + b.n, size + b.n * b.size
    if blocks:
        yield start, len(blocks)


def _plan(blocks: list[Block]) -> tuple[list[list[Block]], list[tuple[int, list[int]]]]:
    """Groups of blocks of vectors of one length, and tasks: a group, and groups that it meets, itself or later ones."""
    sizes = defaultdict(list)
    for b in sorted(blocks):
        sizes[b.size].append(b)
    groups, runs = [], []
    for of_size in sizes.values():
        most = min(GROUP_BYTES, max(PART_BYTES, sum(b.n * b.size for b in of_size) // PARTS))
        first, n, total = len(groups), 0, 0
        for b in of_size:
            if len(groups) == first or total + b.n * b.size > most or n + b.n > GROUP:
                groups.append([])
                n, total = 0, 0
            groups[-1].append(b)
            n, total = n + b.n, total + b.n * b.size
        runs += [(g, range(g, len(groups))) for g in range(first, len(groups))]
    width = -(-sum(len(others) for _, others in runs) // MOST_TASKS)
    return groups, [(g, list(others[i : i + width])) for g, others in runs for i in range(0, len(others), width)]


def _staged(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    path = new_work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def range_join(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `vectors`: its id; n_links, how many other vectors have a cosine of at least
    `cosine` with it; component_id, the smallest id it can reach by links; and kept, whether that is its own."""
    spark = vectors.sparkSession
    floats = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    dtype = np.float32 if floats else np.float64
    vec = F.col(vector_col).cast("array<float>" if floats else "array<double>")
    given = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"))
    id_type = given.schema["id"].dataType.simpleString()
    read, read_path = _staged(given.mapInArrow(_usable(dtype), f"id {id_type}, key binary, vec binary"), "vectors")
    rows = frames.stage(read.select("id", "key"), "vector_ids")
    usable = read.where("key is not null").select("key", "vec")
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    weight = (size.bytes or 8) // np.dtype(dtype).itemsize * 8
    most = max(1, PIVOT_BYTES // weight)
    k = min(-(-size.n // cell), MOST_PIVOTS, most)
    # keys are hashes, so the smallest are a sample that does not depend on the order of rows; about as many as are
    # wanted come to the driver, by a limit on the keys' first bytes
    limit = (2 * min(max(k, SAMPLE), most) << 32) // max(size.n, 1)
    few = usable if limit >= 1 << 32 else usable.where(F.substring("key", 1, 4) < F.lit(limit.to_bytes(4, "big")))
    found = few.groupBy("key").agg(F.any_value("vec").alias("vec")).collect() or usable.limit(1).collect()
    found = [bytes(r.vec) for r in sorted(found, key=lambda r: bytes(r.key))]
    chosen = _by_length(found[:k])
    samples = {n: _stack([found[i] for i in at], dtype) for n, at in _by_length(found).items() if n in chosen}
    held = spark.sparkContext.broadcast({n: Space(x[: len(chosen[n])], _basis(x, cosine)) for n, x in samples.items()})
    homes, homes_path = _staged(
        usable.mapInArrow(
            _homes(held, dtype), "key binary, copies bigint, vec binary, size int, cell int, near double"
        ),
        "homes",
    )
    remove_folders(spark, [read_path])
    most = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.col("size"))))
    parts = homes.groupBy("size", "cell").agg(F.ceil(F.count("vec") / F.first(most)).cast("int").alias("parts"))
    # at most one row for as many vectors as a block holds
    sliced = homes.join(F.broadcast(parts.where("parts > 1")), ["size", "cell"], "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.lit(0))
    )
    folder = new_work_path(spark, "cells")
    blocks = frames.stage(
        sliced.select("size", "cell", "part", "key", "copies", "vec", "near")
        .repartition("size", "cell", "part")
        .sortWithinPartitions("size", "cell", "part", "key")
        .mapInArrow(_pack(folder), "size int, cell int, n int, near double, file string, at bigint"),
        "blocks",
    )
    groups, tasks = _plan([Block(*b) for b in blocks.collect()])
    remove_folders(spark, [homes_path])
    plan = spark.sparkContext.broadcast((groups, tasks))
    numbers = spark.range(0, len(tasks), 1, max(1, len(tasks)))
    found = frames.stage(
        numbers.mapInArrow(_meet(held, plan, folder, cosine, dtype), "key binary, links bigint, root binary"),
        "vector_links",
    )
    remove_folders(spark, [folder])
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = frames.components(found, "key", "root").withColumnRenamed("node", "key")
    classes = frames.stage(
        rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")),
        "vector_classes",
    )
    named = (
        classes.join(links, "key", "left")
        .join(roots, "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = frames.stage(
        named.join(first, "component").select(
            "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "vector_classes",
    )
    out = rows.select("id", "key").join(result, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
