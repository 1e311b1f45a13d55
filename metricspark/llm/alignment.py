"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how usual each pair is.

Both tokenizers read a whole text first. Where a token that is marked by a space begins in both at the same
byte, all before it ends at the same byte too: such verified anchors cut a text into windows of token ids, most
of them words. A window's alignment depends on its two tuples of ids alone, so it is worked out once per block
of texts, for all new windows of a slice together, and looked up by these tuples ever after.

Blocks are runs of rows of a task with a bounded size of text. A block hands on its different id pairs, each with
the number of its documents that hold it linked, its windows as lists of these pairs, and its documents as lists
of windows. Pairs are counted over all blocks by a shuffle on the pair, of one row per pair and block at most; the
counts go back to the blocks that asked, one row per pair and block again, and there become sums per window, then
per document. No table of pairs is broadcast or collected, and no text is read twice.

Defined results: a null or empty text, and one whose joined token bytes differ from a space and the text in either
tokenizer, has no tokens: zeros, and an empty text as digest. A row is a document, also if its id repeats or is
null; other columns are ignored. Special tokens' strings in texts are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.llm import frames

# Bytes of text in a block, and in a slice that is tokenized at once.
BLOCK = 16 << 20
SLICE = 2 << 20
# Vocabulary files of more bytes are refused, as they are sent to every task.
MOST_FILE_BYTES = 64 << 20
# Fixed value: how the byte-level tokenizer cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the piece tokenizer's mark of a space.
MARK = "▁"

ORDER = {"answer": 0, "windows": 1, "document": 2}


# -- tokenizers --------------------------------------------------------------------------------


@functools.cache
def byte_of() -> dict[str, int]:
    """The byte each character of a byte-level token stands for: printable ones for themselves, the others, in
    order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, their lengths, whether they begin with a space, and ids as decimal text."""

    tokens: list[bytes]
    lengths: np.ndarray
    spaced: np.ndarray
    texts: list[str]

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        spaced = np.array([t.startswith(b" ") for t in tokens])
        return cls(tokens, np.array([len(t) for t in tokens], np.int64), spaced, [str(i) for i in range(len(tokens))])


def byte_level(data: bytes) -> tuple[Any, Vocabulary]:
    """An encoder and the vocabulary of a tokenizer file with byte-level BPE whose merges are ordered as its ids."""
    model = json.loads(data)["model"]
    at = byte_of()
    ranks = {bytes(at[c] for c in t): i for t, i in model["vocab"].items() if all(c in at for c in t)}
    special = {t["content"]: t["id"] for t in json.loads(data).get("added_tokens", [])}
    ranks = {t: i for t, i in ranks.items() if i not in special.values()}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][m] for m in merged]
    if order != sorted(order):
        raise ValueError("merges are not ordered as their ids, which the encoder takes for their ranks")
    tokens = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    encoding = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return encoding, Vocabulary.of(tokens)


def pieces(data: bytes) -> tuple[Any, Vocabulary]:
    """An encoder and the vocabulary of a piece model with byte fallback."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokens = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            tokens.append(b"")
        else:
            tokens.append(piece.replace(MARK, " ").encode())
    return model, Vocabulary.of(tokens)


_loaded: dict[str, tuple[Any, Vocabulary]] = {}


def _load(kind: Any, held: Broadcast[bytes]) -> tuple[Any, Vocabulary]:
    key = f"{kind.__name__}-{hashlib.sha256(held.value).hexdigest()}"
    if key not in _loaded:
        _loaded[key] = kind(held.value)
    return _loaded[key]


# -- windows -----------------------------------------------------------------------------------


def _joined(tokens: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and where each list begins (one more than lists)."""
    at = np.cumsum([0, *map(len, lists)])
    out = np.empty(at[-1], np.int32)
    for x, i in zip(lists, at):
        out[i : i + len(x)] = x
    return out, at


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


@dataclass
class Slice:
    """Windows of the texts of a slice: ids of both sides, and where windows and texts begin in them."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray  # of each window, one more than windows
    b_at: np.ndarray
    text_at: np.ndarray  # the first window of each text, one more than texts


def cut(texts: list[list[int]], others: list[list[int]], va: Vocabulary, vb: Vocabulary) -> Slice:
    """Cut tokenized texts, whose sides cover the same bytes, at their anchors."""
    a, a_text = _flat(texts)
    b, b_text = _flat(others)
    a_ends, b_ends = np.cumsum(va.lengths[a]), np.cumsum(vb.lengths[b])
    a_starts, b_starts = a_ends - va.lengths[a], b_ends - vb.lengths[b]
    marked_a, marked_b = np.flatnonzero(va.spaced[a]), np.flatnonzero(vb.spaced[b])
    # a shared start of two marked tokens is verified by its byte
    _, at_a, at_b = np.intersect1d(a_starts[marked_a], b_starts[marked_b], assume_unique=True, return_indices=True)
    first_a, first_b = marked_a[at_a], marked_b[at_b]
    # texts begin with a window of their own
    a_at = _distinct(np.concatenate([first_a, a_text[:-1]]))
    b_at = _distinct(np.concatenate([first_b, b_text[:-1]]))
    return Slice(a, b, np.append(a_at, len(a)), np.append(b_at, len(b)), np.searchsorted(a_at, np.append(a_text[:-1], len(a))))


@dataclass
class Block:
    """What a block keeps of its windows, by their numbers in order of appearance."""

    va: Vocabulary
    vb: Vocabulary
    number: dict[tuple[bytes, bytes], int] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    groups: list[np.ndarray] = field(default_factory=list)  # how many per window, slice by slice
    pairs: list[np.ndarray] = field(default_factory=list)  # links of all windows in a row
    links: list[np.ndarray] = field(default_factory=list)  # how many per window
    held: list[np.ndarray] = field(default_factory=list)  # document * 2**32 + window, each once
    documents: int = 0
    size: int = 0

    def add(self, s: Slice) -> np.ndarray:
        """The number of every window of a slice."""
        a, b = s.a.tobytes(), s.b.tobytes()
        a_at, b_at = (4 * s.a_at).tolist(), (4 * s.b_at).tolist()
        number, out, new = self.number, np.empty(len(a_at) - 1, np.int64), []
        for i, (p, q, r, t) in enumerate(zip(a_at, a_at[1:], b_at, b_at[1:])):
            key = (a[p:q], b[r:t])
            n = number.get(key)
            if n is None:
                n = number[key] = len(number)
                new.append(i)
            out[i] = n
        if new:
            self._align(s, np.array(new))
        which = np.repeat(np.arange(len(s.text_at) - 1), np.diff(s.text_at)) + self.documents
        self.held.append(_distinct((which.astype(np.int64) << 32) | out))
        self.documents += len(s.text_at) - 1
        return out

    def _align(self, s: Slice, new: np.ndarray) -> None:
        """Align the windows `new` of a slice, laid end to end: each shared end closes a group, and what lies
        between two ends of either side is the overlap of one pair of tokens."""
        a, a_at = _ranges(s.a, s.a_at, new)
        b, b_at = _ranges(s.b, s.b_at, new)
        a_ends, b_ends = np.cumsum(self.va.lengths[a]), np.cumsum(self.vb.lengths[b])
        closes = a_ends[a_at[1:] - 1]
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        ends = _distinct(np.concatenate([a_ends, b_ends]))
        pair = (a[np.searchsorted(a_ends, ends)].astype(np.int64) << 32) | b[np.searchsorted(b_ends, ends)]
        self.pairs.append(pair)
        self.links.append(np.bincount(np.searchsorted(closes, ends), minlength=len(new)))
        group_window = np.searchsorted(closes, shared)
        counts = np.bincount(group_window, minlength=len(new))
        self.groups.append(counts)
        ta, tb = self.va.texts, self.vb.texts
        sa, sb = [ta[i] for i in a.tolist()], [tb[i] for i in b.tolist()]
        p = r = 0
        groups = []
        for q, t in zip((np.searchsorted(a_ends, shared) + 1).tolist(), (np.searchsorted(b_ends, shared) + 1).tolist()):
            groups.append(f"{sa[p]}|{sb[r]}" if q - p == 1 == t - r else f"{','.join(sa[p:q])}|{','.join(sb[r:t])}")
            p, r = q, t
        at = 0
        for n in counts.tolist():
            self.texts.append(groups[at] if n == 1 else ";".join(groups[at : at + n]))
            at += n

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs, in how many documents each is linked, and per window where its links begin and
        their places among the pairs."""
        links = np.concatenate([np.zeros(1, np.int64), *self.links])
        flat = np.concatenate([np.zeros(0, np.int64), *self.pairs])
        pairs = _distinct(flat)
        place = np.searchsorted(pairs, flat)
        at = np.cumsum(links)
        docs = np.zeros(len(pairs), np.int64)
        for held in self.held:
            document, window = held >> 32, held & 0xFFFFFFFF
            n = links[window + 1]
            first = np.repeat(at[window] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            found = (np.repeat(document, n) << 32) | place[first + np.arange(len(first))]
            docs += np.bincount(_distinct(found) & 0xFFFFFFFF, minlength=len(pairs))
        return pairs, docs, at, place


def _ranges(values: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ranges of values one after another, and where each begins (one more than ranges)."""
    n = at[chosen + 1] - at[chosen]
    out = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(at[chosen] - out[:-1], n) + np.arange(out[-1])], out


# -- blocks ------------------------------------------------------------------------------------

_ALIGNED = (
    "kind string, block bigint, id {id}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
    "windows binary, pairs binary, place int, pair bigint, n bigint"
)


def _batch(schema: pa.Schema, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def _same(value: Any, n: int, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def _align(files: tuple[Broadcast, Broadcast], block_bytes: int):
    """Rows of three kinds: documents, and at the end of each block its windows and its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encoding, va), (model, vb) = _load(byte_level, files[0]), _load(pieces, files[1])
        task, done, block = TaskContext.get().partitionId() << 32, 0, Block(va, vb)

        def closed(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            pairs, docs, at, place = block.tables()
            number = task + done
            both = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (at, place)]
            yield _batch(
                schema, 1, kind=pa.array(["windows"]), block=_same(number, 1, pa.int64()), windows=both[0], pairs=both[1]
            )
            for i in range(0, len(pairs), 1 << 16):
                some, n = pairs[i : i + (1 << 16)], docs[i : i + (1 << 16)]
                yield _batch(
                    schema, len(some), kind=_same("pair", len(some), pa.string()), block=_same(number, len(some), pa.int64()),
                    place=pa.array(np.arange(i, i + len(some), dtype=np.int32)), pair=pa.array(some), n=pa.array(n),
                )

        schema = None
        for batch in frames.slices(batches, 1, SLICE):
            if schema is None:
                text, number = pa.string(), pa.int64()
                schema = pa.schema(
                    [("kind", text), ("block", number), ("id", batch.column(0).type), ("n_a", number), ("n_b", number)]
                    + [("n_groups", number), ("groups_sha256", text), ("windows", pa.binary()), ("pairs", pa.binary())]
                    + [("place", pa.int32()), ("pair", number), ("n", number)]
                )
            yield documents(schema, batch, encoding, model, block, task + done)
            block.size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if block.size >= block_bytes:
                yield from closed(schema)
                done, block = done + 1, Block(va, vb)
        if schema is not None and block.documents:
            yield from closed(schema)

    return run


def documents(
    schema: pa.Schema, batch: pa.RecordBatch, encoding: Any, model: Any, block: Block, number: int
) -> pa.RecordBatch:
    """The rows of a slice of documents, whose windows are added to the block."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    b_ids = model.encode(texts, num_threads=1)
    a_ids: list[list[int]] = []
    for i, text in enumerate(texts):
        ids, whole = [], " " + text
        if text:
            ids, data = encoding.encode_ordinary(whole), whole.encode()
            if _joined(block.vb.tokens, b_ids[i]) != data or _joined(block.va.tokens, ids) != data:
                ids = []
        if not ids:
            b_ids[i] = []
        a_ids.append(ids)
    full = [i for i, ids in enumerate(a_ids) if ids]
    n = len(texts)
    windows, digests, groups = [b""] * n, [""] * n, np.zeros(n, np.int64)
    if full:
        s = cut([a_ids[i] for i in full], [b_ids[i] for i in full], block.va, block.vb)
        numbers = block.add(s)
        per_window = np.concatenate(block.groups)
        block.groups = [per_window]
        held, at, words = numbers.astype("<u4"), s.text_at.tolist(), block.texts
        for i, p, q in zip(full, at, at[1:]):
            windows[i] = held[p:q].tobytes()
            digests[i] = hashlib.sha256(";".join([words[w] for w in numbers[p:q].tolist()]).encode()).hexdigest()
        groups[full] = np.add.reduceat(per_window[numbers], s.text_at[:-1])
    return _batch(
        schema, n, kind=_same("document", n, pa.string()), block=_same(number, n, pa.int64()), id=batch.column(0),
        n_a=pa.array(list(map(len, a_ids)), pa.int64()), n_b=pa.array(list(map(len, b_ids)), pa.int64()),
        n_groups=pa.array(groups), groups_sha256=pa.array(digests), windows=pa.array(windows, pa.binary()),
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with what their links sum to. Of each block the answers come first, then its windows."""
    current, counts, best = None, [], []
    at = per_window = None
    for batch in batches:
        block, order = (batch.column(i).to_numpy() for i in (0, 1))
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(order) != 0)) + 1
        for start, end in zip([0, *edges], [*edges, len(block)]):
            if start == end:
                continue
            rows = batch.slice(start, end - start)
            if block[start] != current:
                current, counts, best, at = block[start], [], [], None
            if order[start] == ORDER["answer"]:
                counts.append((rows.column("place").to_numpy(), rows.column("n").to_numpy(), rows.column("best").to_numpy(zero_copy_only=False)))
            elif order[start] == ORDER["windows"]:
                at = np.frombuffer(rows.column("windows")[0].as_py(), "<i4").astype(np.int64)
                place = np.frombuffer(rows.column("pairs")[0].as_py(), "<i4")
                per_window = _per_window(counts, place, at)
                counts = []
            else:
                yield _document_sums(rows, per_window)


def _per_window(counts: list[tuple], place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each window the sum of its links' counts, and how many of its links are the best of their A id."""
    n, best = (np.zeros(int(place.max(initial=-1)) + 1, np.int64) for _ in range(2))
    for places, some, is_best in counts:
        n[places], best[places] = some, is_best
    return np.array([np.add.reduceat(x[place], at[:-1]) if len(at) > 1 else np.zeros(0, np.int64) for x in (n, best)])


def _document_sums(rows: pa.RecordBatch, per_window: np.ndarray) -> pa.RecordBatch:
    sums = np.zeros((2, len(rows)), np.int64)
    for i, data in enumerate(rows.column("windows")):
        if len(windows := np.frombuffer(data.as_buffer(), "<u4")):
            sums[:, i] = per_window[:, windows].sum(axis=1)
    kept = [rows.column(c) for c in ("id", "n_a", "n_b", "n_groups", "groups_sha256")]
    names = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"]
    return pa.RecordBatch.from_arrays([*kept, pa.array(sums[1]), pa.array(sums[0])], names=names)


@dataclass
class Alignment:
    """Documents aligned, and the counts of their id pairs."""

    documents: DataFrame
    pairs: DataFrame


def align(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK,
) -> Alignment:
    """`documents`: per row its id, n_a and n_b (tokens), n_groups (runs between shared ends), n_links (overlapping
    pairs), n_best (links whose id pair is in as many documents as any with its A id), count_sum (documents that
    hold each link's id pair, over all links) and groups_sha256. `pairs`: (a, b, n, best), an id pair, the number of
    documents that hold it linked, and whether no pair with the same A id is in more."""
    spark = docs.sparkSession
    files = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as f:
            data = f.read(MOST_FILE_BYTES + 1)
        if len(data) > MOST_FILE_BYTES:
            raise ValueError(f"{path} has more than {MOST_FILE_BYTES} bytes")
        files.append(spark.sparkContext.broadcast(data))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    aligned = given.mapInArrow(_align((files[0], files[1]), block_bytes), _ALIGNED.format(id=id_type))
    aligned = frames.stage(aligned, "aligned", "kind")
    asked = aligned.where("kind = 'pair'").select("block", "place", "pair", "n")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = frames.stage(counts, "pair_counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counted = counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.drop("n").join(counted, "pair")
    nothing = {c: F.lit(None) for c in ("id", "n_a", "n_b", "n_groups", "groups_sha256", "windows", "pairs", "place", "n", "best")}
    types = dict(aligned.dtypes) | {"best": "boolean"}

    def rows(frame: DataFrame, kind: str) -> DataFrame:
        has = {c: F.col(c) for c in frame.columns}
        columns = [(has.get(c, none)).cast(types[c]).alias(c) for c, none in nothing.items()]
        return frame.select("block", F.lit(ORDER[kind]).alias("order"), *columns)

    every = (
        rows(answers.select("block", "place", "n", "best"), "answer")
        .union(rows(aligned.where("kind = 'windows'").select("block", "windows", "pairs"), "windows"))
        .union(
            rows(
                aligned.where("kind = 'document'").select("block", "id", "n_a", "n_b", "n_groups", "groups_sha256", "windows"),
                "document",
            )
        )
    )
    sums = (
        every.repartition("block")
        .sortWithinPartitions("block", "order")
        .mapInArrow(
            _summed,
            f"id {id_type}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint",
        )
    )
    out = sums.select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
        "n_best",
        "count_sum",
        "groups_sha256",
    )
    id_pairs = counted.select(
        F.col("a").cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n", "best"
    )
    return Alignment(out, id_pairs)
