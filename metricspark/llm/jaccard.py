"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Texts with the same words in the same order, and equal texts without words, are one class from the start and travel as
one row.
Each class has one hash per band, equal for two classes with the probability similarity ** rows;
classes that share a band hash meet in that hash's cell. Cells with the same members are one cell.
A large cell is cut into blocks, and each pair of blocks is a task of bounded size that compares its
classes on their whole n-gram sets. Tasks give each class its number of links and one edge to the
smallest class it hangs together with there, so no pairs leave a task, whatever the size of a group.

Defined results: null is an empty text; texts without words are linked only if they are equal, code point by code point;
a text of fewer than `k` words has one n-gram of all its words; repeated rows and rows with the same id are rows of their
own; null ids sort last in a group; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.llm import frames
from metricspark.llm.texts import U64, mix, shingle_hashes, word_hashes

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999

# What one side of a comparison holds: classes, and n-grams on average.
BLOCK = 256
BLOCK_GRAMS = 1 << 20
# Columns of the matrices in which shared n-grams are counted.
COLUMNS = 4096
# Bytes of text whose n-grams are hashed at once.
SLICE = 1 << 20


def choose_bands(similarity: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that pairs at `similarity` share a band with
    probability `recall` within a number of hashes. More rows mean fewer false candidates."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, most_hashes):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def band_hashes(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per text and band, from the minima of `rows` hashes each; texts without n-grams have 0."""
    random = np.random.default_rng(1)
    masks = random.integers(0, 1 << 64, bands * rows, U64)
    factors = random.integers(0, 1 << 64, bands * rows, U64) | U64(1)
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, bands), U64)
    if len(full):
        starts = begin[full]
        for band in range(bands):
            total = np.full(len(full), band + 1, U64)
            for i in range(band * rows, (band + 1) * rows):
                total = mix(total + np.minimum.reduceat((grams ^ masks[i]) * factors[i], starts))
            out[full, band] = total
    return out


def _sketch(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            words, begin = word_hashes(texts)
            grams, at = shingle_hashes(words, begin, k)
            digests = _digests(texts, words, begin)
            hashes = band_hashes(grams, at, bands, rows).view(np.int64)
            offsets = np.where(np.diff(at) > 0, bands, 0)
            flat = hashes[np.diff(at) > 0].ravel()
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(offsets)]).astype(np.int32)), pa.array(flat)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), lists],
                names=["id", "text_hash", "text_class", "bands"],
            )

    return run


def _digests(texts: list[str | None], words: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """What tells a text's class: its words, or all of the text if it has none."""
    hashed = [
        (words[a:b].tobytes(), b"words") if b > a else ((text or "").encode(), b"text")
        for text, a, b in zip(texts, begin.tolist(), begin[1:].tolist())
    ]
    return [hashlib.blake2b(data, digest_size=16, person=person).digest() for data, person in hashed]


def _gram_sets(k: int):
    """The n-gram set of each text that has the class asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            words, begin = word_hashes(texts)
            grams, at = shingle_hashes(words, begin, k)
            classes, sets = [], []
            for i, (text_class, digest) in enumerate(zip(batch.column(0).to_pylist(), _digests(texts, words, begin))):
                if digest == text_class:
                    classes.append(text_class)
                    sets.append(np.unique(grams[at[i] : at[i + 1]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(classes, pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                ],
                names=["text_class", "grams", "n_grams"],
            )

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    lv, rv = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(lv), np.unique(rv), assume_unique=True)

    def placed(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, values)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == values[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    (lc, lr), (rc, rr) = placed(lv, left), placed(rv, right)
    for start in range(0, len(common), COLUMNS):
        x = np.zeros((len(left), COLUMNS), np.float32)
        y = np.zeros((len(right), COLUMNS), np.float32)
        for m, c, r in ((x, lc, lr), (y, rc, rr)):
            i, j = np.searchsorted(c, [start, start + COLUMNS])
            m[r[i:j], c[i:j] - start] = 1
        out += x @ y.T
    return out


def _roots(link: np.ndarray, names: list[list[bytes]]) -> list[list[bytes]]:
    """The smallest name that each row and each column of a link matrix hangs together with."""
    order = sorted({*names[0], *names[1]})
    place = {name: i for i, name in enumerate(order)}
    left, right = (np.array([place[n] for n in side]) for side in names)
    while True:
        to_right = np.minimum(right, np.where(link, left[:, None], len(order)).min(axis=0))
        to_left = np.minimum(left, np.where(link, to_right[None, :], len(order)).min(axis=1))
        if (to_left == left).all() and (to_right == right).all():
            return [[order[i] for i in left], [order[i] for i in right]]
        if names[0] == names[1]:
            to_left = to_right = np.minimum(to_left, to_right)
        left, right = to_left, to_right


def _compare(similarity: float):
    """Links between the classes of a unit: one row per class with links, hung on a smallest class."""

    def unit(cell: int, first: int, second: int, rows: list[dict]) -> Iterator[tuple]:
        left = [r for r in rows if r["block"] == first]
        right = left if first == second else [r for r in rows if r["block"] == second]
        if not left or not right:
            return
        sets = {id(r): np.frombuffer(r["grams"], U64) for r in rows}
        shared = _shared([sets[id(r)] for r in left], [sets[id(r)] for r in right])
        sizes = [np.array([len(sets[id(r)]) for r in side], np.float64) for side in (left, right)]
        shared = shared.astype(np.float64)
        link = shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-9
        if first == second:
            link &= ~np.eye(len(left), dtype=bool)
        # a pair that meets in several cells counts in the smallest of them
        earlier = [[np.array([c for c in r["cells"] if c < cell], np.int64) for r in side] for side in (left, right)]
        owned = link & (_shared(*earlier) == 0) if any(map(len, earlier[0])) else link
        copies = [np.array([r["copies"] for r in side], np.int64) for side in (left, right)]
        counts = [owned @ copies[1], copies[0] @ owned]
        names = [[r["text_class"] for r in side] for side in (left, right)]
        roots = _roots(link, names)
        for side in (0, 1) if first != second else (0,):
            for i in np.flatnonzero(link.any(axis=1 - side)):
                yield names[side][i], int(counts[side][i]), roots[side][i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.binary()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.binary()),
                ],
                names=["text_class", "links", "root"],
            )

        key, rows = None, []
        for batch in frames.slices(batches, 7, 16 << 20):
            for r in batch.to_pylist():
                k = (r["cell"], r["first"], r["second"])
                if k != key:
                    if rows:
                        yield out(list(unit(*key, rows)))
                    key, rows = k, []
                rows.append(r)
        if rows:
            yield out(list(unit(*key, rows)))

    return run


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of `docs`: its id, class_id, the smallest id it hangs together with by links, and
    n_links, the number of other rows whose k-word shingle sets have a Jaccard similarity of at least
    `similarity` (found with probability `recall` or more; equal texts always)."""
    bands, rows = choose_bands(similarity, recall)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    sketches = frames.stage(
        texts.mapInArrow(
            _sketch(bands, rows, k), f"id {id_type}, text_hash bigint, text_class binary, bands array<bigint>"
        ),
        "sketches",
    )
    # of each class the first row, which its id and text tell: ids may be null or shared by many rows
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    classes = frames.stage(
        sketches.groupBy("text_class")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
        .select("text_class", F.col("first.id").alias("first_id"), "first.text_hash", "copies", "bands"),
        "text_classes",
    )
    placed = classes.select("text_class", F.explode("bands").alias("cell"))
    # the same members under several bands are one cell: the members' sum and their exclusive or tell
    member = F.xxhash64("text_class")
    cells = frames.stage(
        placed.groupBy("cell")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(member).alias("xor"),
            F.sum(F.xxhash64(F.lit(7), "text_class").cast("decimal(20,0)")).alias("sum"),
        )
        .where("size > 1")
        .groupBy("size", "xor", "sum")
        .agg(F.min("cell").alias("cell"))
        .select("cell", "size"),
        "cells",
    )
    members = frames.stage(placed.join(cells, "cell"), "members")
    of_class = members.groupBy("text_class").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    wanted = classes.join(of_class.select("text_class"), "text_class", "left_semi")
    # texts come from the first row of each class; another text with the same hash has another class and drops out
    chosen = wanted.select(F.col("first_id").alias("id"), F.col("text_hash").alias("chosen_hash"), "text_class")
    same_row = texts["id"].eqNullSafe(chosen["id"]) & (texts["text_hash"] == chosen["chosen_hash"])
    some = (
        texts.join(chosen, same_row)
        .select("text_class", "text")
        .mapInArrow(_gram_sets(k), "text_class binary, grams binary, n_grams bigint")
        .groupBy("text_class")
        .agg(F.any_value("grams").alias("grams"), F.any_value("n_grams").alias("n_grams"))
    )
    grams = frames.stage(
        some.join(of_class, "text_class").join(classes.select("text_class", "copies"), "text_class"), "grams"
    )
    weights = members.join(grams.select("text_class", "n_grams"), "text_class")
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_GRAMS))
    blocks = frames.stage(weights.groupBy("cell").agg(n.cast("int").alias("n")), "blocks")
    block = F.pmod(F.xxhash64("cell", "text_class"), F.col("n")).cast("int")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    units = (
        members.join(blocks, "cell")
        .withColumn("block", block)
        .withColumn("other", F.explode(others))
        .select(
            "cell", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
            "block", "text_class",
        )
        .join(grams.drop("n_grams"), "text_class")
        .select("cell", "first", "second", "block", "text_class", "cells", "copies", "grams")
    )
    keys = ("cell", "first", "second")
    found = frames.stage(
        units.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_compare(similarity), "text_class binary, links bigint, root binary"),
        "links",
    )
    links = found.groupBy("text_class").agg(F.sum("links").alias("links"))
    roots = frames.components(found, "text_class", "root")
    named = (
        classes.select("text_class", "first_id", "copies")
        .join(links, "text_class", "left")
        .join(roots.withColumnRenamed("node", "text_class"), "text_class", "left")
        .withColumn("component", F.coalesce("component", "text_class"))
    )
    first = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    result = named.join(first, "component").select(
        "text_class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return sketches.join(result, "text_class").select(F.col("id").alias(id_col), "class_id", "n_links")
