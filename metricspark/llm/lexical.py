"""Ranked lexical search: the best documents of every item, by best-first splitting of document intervals.

Documents are indexed in blocks, runs of rows of a task with a bounded size of text. Within a block documents are
numbered in the order of their ids, and each term that an item may hold has a posting list: document numbers and
term frequencies. Terms no item holds are left out by a bitmap of term hashes, whose size is fixed. Document counts
and lengths are summed over all blocks before anything is scored.

A search task holds a number of items and takes its blocks one after another. In a block it lays a range-maximum
sparse table over each posting list: for every power of two, where the greatest impact of so many postings is. The
sum of an item's weights times their lists' maxima between two documents bounds the score of every document there.
The search always splits the intervals of the greatest bounds, at the document of the greatest single impact: that
document is scored exactly, and both rests are bounded anew by two look-ups per list. Intervals whose bound cannot
reach the item's k best so far go, where equal scores count by the smallest id of the interval; the k best of a
block are what the next block has to beat. What leaves a task is k documents per item.

Items are dealt over groups of a bounded number, each of which reads the index once.

Defined results: a null or empty text has no terms; a row is a document, and an item, also if its id repeats; null
document ids come last among equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricspark.llm import frames

BEST = 10
# Bytes of text in a block of the index.
BLOCK = 16 << 20
# Blocks that a search task takes one after another, and items it holds, on average.
BLOCKS_A_TASK = 4
ITEMS_A_TASK = 4096
# Bits of the map of term hashes.
BITS = 1 << 23
# Intervals split at once.
SPLITS = 128

# What the impact of a term is made of.
SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 8, 75, 1000

# bytes of terms, A-Z lower-cased, and a blank for all others; UTF-8 beyond ASCII belongs to terms
_TERM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order: runs of ASCII letters and digits and of all other code points beyond ASCII."""
    return (text or "").encode().translate(_TERM).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames.slices(batches, 1):
        asked = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        rows = [(q, t, n) for q, text in asked for t, n in Counter(terms(text)).items()]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        kinds = (pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["q", "term", "times"])


# -- index -------------------------------------------------------------------------------------


class _Block:
    def __init__(self) -> None:
        self.ids: list[Any] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}
        self.size = 0

    def add(self, identity: Any, text: str | None, wanted: bytes) -> None:
        found = terms(text)
        at = len(self.ids)
        self.ids.append(identity)
        self.lengths.append(len(found))
        for term, n in Counter(found).items():
            bit = xxhash.xxh64_intdigest(term, 42) & (BITS - 1)
            if wanted[bit >> 3] >> (bit & 7) & 1:
                docs, counts = self.lists.setdefault(term, ([], []))
                docs.append(at)
                counts.append(n)
        self.size += len(text or "") + 1

    def rows(self, number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = ["block", "term", "docs", "counts", "ids", "n_docs", "n_terms"]
        lengths = np.array(self.lengths, np.int64)[order]
        ids = pa.array([[self.ids[i] for i in order]], pa.list_(id_type))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.array([None], pa.binary()), pa.array([lengths.astype("<i8").tobytes()], pa.binary()),
                pa.array([None], pa.binary()), ids, pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
            ],
            names=names,
        )
        some = list(self.lists)
        for start in range(0, len(some), 4096):
            chosen = some[start : start + 4096]
            docs, counts, n = [], [], []
            for term in chosen:
                where = place[self.lists[term][0]]
                by = np.argsort(where)
                docs.append(where[by].astype("<i4").tobytes())
                counts.append(np.array(self.lists[term][1], "<i4")[by].tobytes())
                n.append(len(where))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * len(chosen), pa.int64()), pa.array(chosen, pa.binary()), pa.array(docs, pa.binary()),
                    pa.array(counts, pa.binary()), pa.nulls(len(chosen), pa.list_(id_type)), pa.array(n, pa.int64()),
                    pa.nulls(len(chosen), pa.int64()),
                ],
                names=names,
            )


def _index(wanted: Broadcast[bytes], block_bytes: int):
    """Rows of a block: one without a term for its documents, and one per posting list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, block, id_type = TaskContext.get().partitionId() << 32, 0, _Block(), None
        for batch in frames.slices(batches, 1):
            id_type = batch.column(0).type
            for identity, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(identity, text, wanted.value)
            if block.size >= block_bytes:
                yield from block.rows(task + done, id_type)
                done, block = done + 1, _Block()
        if block.ids:
            yield from block.rows(task + done, id_type)

    return run


def _bitmap(term: DataFrame) -> bytes:
    """A map of BITS bits with those set that a term's hash names; what comes to the driver has this size."""
    bit = F.xxhash64("term").bitwiseAND(F.lit(BITS - 1))
    words = (
        term.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
        .collect()
    )
    out = np.zeros(BITS // 64, np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.astype("<i8").tobytes()


# -- search ------------------------------------------------------------------------------------


class Postings:
    """The posting lists of a block end to end, and where the greatest impacts are in every power of two of them."""

    def __init__(self, lists: dict[bytes, tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, n_docs: int, n_terms: int):
        self.number = {term: i for i, term in enumerate(lists)}
        sizes = [len(docs) for docs, _ in lists.values()]
        self.at = np.cumsum([0, *sizes])
        self.docs = np.concatenate([np.zeros(0, np.int64), *(docs for docs, _ in lists.values())]).astype(np.int64)
        tf = np.concatenate([np.zeros(0, np.int64), *(counts for _, counts in lists.values())]).astype(np.int64)
        different, which = np.unique(lengths, return_inverse=True)
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * n_docs // max(n_terms, 1) for n in different], np.int64)
        self.impact = SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m[which][self.docs])
        self.n = len(lengths)
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * self.n + self.docs
        levels = [np.arange(len(self.docs), dtype=np.int32)]
        while (1 << len(levels)) <= max(sizes, default=0):
            half, last = 1 << (len(levels) - 1), levels[-1]
            other = np.concatenate([last[half:], last[len(last) - half :]])  # the end is never looked up
            levels.append(np.where(self.impact[last] >= self.impact[other], last, other))
        self.greatest = np.stack(levels)
        self.level_of = np.zeros(max(sizes, default=0) + 1, np.int64)
        for i in range(1, len(levels)):
            self.level_of[1 << i :] = i

    def bounds(self, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per interval (a column of postings per list) the sum of weighted maxima, and the document of the greatest."""
        n = ends - starts
        level = self.level_of[n]
        first = self.greatest[level, np.minimum(starts, len(self.docs) - 1)]
        second = self.greatest[level, np.maximum(ends - (1 << level), 0)]
        where = np.where(self.impact[first] >= self.impact[second], first, second)
        weighted = np.where(n > 0, self.impact[where], 0) * weights[:, None]
        top = weighted.argmax(axis=0)
        return weighted.sum(axis=0), self.docs[where[top, np.arange(len(top))]]

    def search(self, item: Item, ids: list[Any], best: int, splits: int) -> None:
        """Bring the item's k best up to date with this block."""
        held = [(self.number[t], w) for t, w in zip(item.terms, item.weights) if t in self.number]
        if not held:
            return
        lists, weights = (np.array(x, np.int64) for x in zip(*held))
        starts, ends = self.at[lists][:, None], self.at[lists + 1][:, None]
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
        bound, split = self.bounds(starts, ends, weights)
        width = 8
        while len(bound):
            order = np.argsort(-bound, kind="stable")
            now, rest = order[:width], order[width:]
            width = min(2 * width, splits)
            doc = split[now]
            place = np.searchsorted(self.keys, lists[:, None] * self.n + doc[None, :])
            held_here = (place < ends[:, now]) & (self.docs[np.minimum(place, len(self.docs) - 1)] == doc)
            scores = np.where(held_here, self.impact[np.minimum(place, len(self.docs) - 1)], 0) * weights[:, None]
            item.offer(scores.sum(axis=0), doc, ids, best)
            left, right = (starts[:, now], place), (place + held_here, ends[:, now])
            new_starts, new_ends = (np.concatenate([x, y], axis=1) for x, y in zip(left, right))
            new_lo, new_hi = np.concatenate([lo[now], doc + 1]), np.concatenate([doc, hi[now]])
            new_bound, new_split = self.bounds(new_starts, new_ends, weights)
            starts, ends = (np.concatenate([x[:, rest], y], axis=1) for x, y in ((starts, new_starts), (ends, new_ends)))
            lo, hi, bound, split = (
                np.concatenate([x[rest], y])
                for x, y in ((lo, new_lo), (hi, new_hi), (bound, new_bound), (split, new_split))
            )
            kept = item.open(bound, lo, ids, best)
            starts, ends, lo, hi, bound, split = starts[:, kept], ends[:, kept], lo[kept], hi[kept], bound[kept], split[kept]


class Item:
    """An item's terms and weights (times its repeats), and its best documents so far."""

    def __init__(self, number: int):
        self.number = number
        self.terms: list[bytes] = []
        self.weights: list[int] = []
        self.found: list[tuple[int, bool, Any]] = []  # -score, whether the id is null, id

    def least(self, best: int) -> int:
        """The score that a further document must reach."""
        return max(1, -self.found[-1][0]) if len(self.found) >= best else 1

    def offer(self, scores: np.ndarray, docs: np.ndarray, ids: list[Any], best: int) -> None:
        good = np.flatnonzero(scores >= self.least(best))
        if len(good):
            new = [(-int(scores[i]), ids[docs[i]] is None, ids[docs[i]]) for i in good]
            self.found = sorted(self.found + new)[:best]

    def open(self, bound: np.ndarray, lo: np.ndarray, ids: list[Any], best: int) -> np.ndarray:
        """Which intervals may hold a document that belongs to the best: ids ascend within a block, so the first
        of an interval settles whether an equal score would do."""
        least = self.least(best)
        kept = bound >= least
        if len(self.found) >= best:
            last = self.found[-1]
            for i in np.flatnonzero(bound == -last[0]):
                first = ids[lo[i]]
                kept[i] = (first is None, first) < last[1:]
        return np.flatnonzero(kept)


def _search(best: int, splits: int, n_docs: int, n_terms: int):
    """The best documents of each item of a unit among the unit's blocks, in rows sorted by unit and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block = None, None
        items: dict[int, Item] = {}
        lists: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        ids: list[Any] = []
        lengths = np.zeros(0, np.int64)
        id_type = None

        def searched() -> None:
            if lists:
                postings = Postings(lists, lengths, n_docs, n_terms)
                for item in items.values():
                    postings.search(item, ids, best, splits)

        def ranked() -> pa.RecordBatch:
            found = [(item.number, f[2], -f[0]) for item in items.values() for f in item.found]
            columns = list(zip(*found)) if found else [(), (), ()]
            kinds = (pa.int64(), id_type, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["q", "id", "score"])

        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for r in batch.to_pylist():
                if (r["items"], r["slot"]) != unit:
                    if unit is not None:
                        searched()
                        yield ranked()
                    unit, block, items, lists = (r["items"], r["slot"]), None, {}, {}
                if r["block"] is None:
                    item = items.setdefault(r["q"], Item(r["q"]))
                    item.terms.append(r["term"])
                    item.weights.append(r["weight"])
                    continue
                if r["block"] != block:
                    searched()
                    block, lists = r["block"], {}
                if r["term"] is None:
                    ids, lengths = r["ids"], np.frombuffer(r["docs"], "<i8")
                else:
                    lists[r["term"]] = (np.frombuffer(r["docs"], "<i4"), np.frombuffer(r["counts"], "<i4"))
        if unit is not None:
            searched()
            yield ranked()

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    best: int = BEST,
    block_bytes: int = BLOCK,
    splits: int = SPLITS,
    items_a_task: int = ITEMS_A_TASK,
    blocks_a_task: int = BLOCKS_A_TASK,
) -> DataFrame:
    """The `best` documents with the highest scores above 0 of every row of `items`, as (item id, rank, id, score)."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    asked = items.select(
        F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")
    )
    asked = frames.stage(asked, "items")
    item_terms = frames.stage(asked.select("q", "text").mapInArrow(_item_terms, "q bigint, term binary, times bigint"), "item_terms")
    wanted = spark.sparkContext.broadcast(_bitmap(item_terms.select("term").distinct()))
    index = frames.stage(
        given.mapInArrow(
            _index(wanted, block_bytes),
            f"block bigint, term binary, docs binary, counts binary, ids array<{id_type}>, n_docs bigint, n_terms bigint",
        ),
        "lexical_index",
    )
    blocks = index.where("term is null")
    total = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    frequency = index.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weighted = item_terms.join(frequency, "term").select("q", "term", (weight * F.col("times")).alias("weight"))
    groups = max(1, math.ceil(asked.count() / items_a_task))
    slots = max(1, math.ceil(total.blocks / blocks_a_task))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    columns = ("items", "slot", "block", "term", "q", "weight", "docs", "counts", "ids")
    questions = weighted.select(
        part("q", groups).alias("items"), every(slots).alias("slot"), F.lit(None).cast("bigint").alias("block"), "term", "q", "weight",
        F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("counts"),
        F.lit(None).cast(f"array<{id_type}>").alias("ids"),
    )
    postings = index.select(
        every(groups).alias("items"), part("block", slots).alias("slot"), "block", "term", F.lit(None).cast("bigint").alias("q"),
        F.lit(None).cast("bigint").alias("weight"), "docs", "counts", "ids",
    )
    found = (
        questions.select(*columns)
        .union(postings.select(*columns))
        .repartition("items", "slot")
        .sortWithinPartitions("items", "slot", "block", "term")
        .mapInArrow(_search(best, splits, n_docs, n_terms), f"q bigint, id {id_type}, score bigint")
    )
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(asked.select("q", "item"), "q").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )
