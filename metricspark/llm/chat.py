r"""Chat formatting on tokens: segments are encoded one by one and joined with reserved ids.

A turn reads `<|im_start|>role\ntext<|im_end|>\n`. The two marks are ids of their own after the
vocabulary's; text is never encoded into them. Control strings inside a text are escaped besides, so the
formatted text can be told apart too: a `<`, any number of backslashes and a `|` get one backslash more,
and reading takes one away. Roles also write backslashes double and line ends as \n.

A turn's place in its conversation is a prefix sum of the lengths of the turns before it, taken in two
levels (within 1,024 turn numbers, then over those), so a conversation with very many turns is no single
group. The loss mask is a prefix sum too, of +1 where an assistant's text begins and -1 where it ends.
The tokens come out in blocks of a fixed number by their place in the conversation, which bounds a row.

Reading back takes the blocks of a conversation in order, as its digests are of one running text. They
stream through the task; of a conversation, the task holds a block and the turn that is being read.

Defined results: null roles and texts are empty; turns are ordered by turn number, role and text tokens, with
null numbers first; repeated rows are turns of their own; rows whose conversation is null are one
conversation; a conversation without assistant turns has an empty loss text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricspark.llm import bpe, frames

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
BLOCK = 4096
TURNS = 1024  # turn numbers of the first level of prefix sums


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text)


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role), flags=re.S)


def chars(text: bytes) -> int:
    return len(text) - sum(text.count(bytes([b])) for b in range(0x80, 0xC0)) if not text.isascii() else len(text)


class Chats:
    """The template for one vocabulary."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.tokenizer = bpe.Bpe(spark, path, reserved=(START, STOP))
        self.start, self.stop = self.tokenizer.reserved[START], self.tokenizer.reserved[STOP]
        self.line_end = int(bpe.read_vocabulary(path)["byte_ids"][10])
        self.block = block

    def format(
        self,
        rows: DataFrame,
        conv_col: str = "conv_id",
        turn_col: str = "turn",
        role_col: str = "role",
        text_col: str = "text",
    ) -> DataFrame:
        """Blocks of tokens: conv_id, block (0, 1, ...), ids, loss_mask (one 0 or 1 per id)."""
        role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        encoded = rows.select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.floor(F.col(turn_col).cast("double") / TURNS).alias("part"),
            role.alias("role"),
            self.tokenizer.encode(escape_role(role)).alias("role_ids"),
            self.tokenizer.encode(escape(text)).alias("text_ids"),
        ).withColumn("n", F.size("role_ids") + F.size("text_ids") + 4)
        turns = frames.stage(encoded, "turns")
        order = ("turn", "role", "text_ids")
        placed = turns.withColumn(
            "place", F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        )
        parts = turns.groupBy("conv_id", "part").agg(F.sum("n").alias("of_part"))
        parts = parts.withColumn(
            "base", F.sum("of_part").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        )
        base = parts.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), "base")
        same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("part").eqNullSafe(F.col("__part"))
        zero = F.lit(0).cast("long")
        at = placed.join(base, same).withColumn("at", F.coalesce("place", zero) + F.coalesce("base", zero))
        ints = lambda *values: F.array(*(F.lit(v).cast("int") for v in values))
        tokens = F.concat(
            ints(self.start), "role_ids", ints(self.line_end), "text_ids", ints(self.stop, self.line_end)
        )
        # +1 and -1 on the token where a learned text begins and on the one after its end
        rise = F.when((F.col("role") == LEARNED), F.size("role_ids") + 2).otherwise(0)
        fall = F.when((F.col("role") == LEARNED), F.size("role_ids") + 2 + F.size("text_ids")).otherwise(0)
        first, last = F.floor(F.col("at") / self.block), F.floor((F.col("at") + F.col("n") - 1) / self.block)
        cut = at.select(
            "conv_id", "at", "n", tokens.alias("tokens"), rise.alias("rise"), fall.alias("fall"),
            F.explode(F.sequence(first, last)).alias("block"),
        )
        begin = F.greatest(F.col("block") * self.block - F.col("at"), zero).cast("int")
        end = F.least((F.col("block") + 1) * self.block - F.col("at"), F.col("n").cast("long")).cast("int")
        piece = cut.select(
            "conv_id",
            "block",
            (F.col("at") + begin).alias("at"),
            F.slice("tokens", begin + 1, end - begin).alias("ids"),
            (F.col("rise") - begin).alias("rise"),
            (F.col("fall") - begin).alias("fall"),
        )
        blocks = piece.groupBy("conv_id", "block").agg(
            F.sort_array(F.collect_list(F.struct("at", "ids", "rise", "fall"))).alias("pieces")
        )
        return blocks.select(
            "conv_id",
            "block",
            F.flatten("pieces.ids").alias("ids"),
            F.arrow_udf(_mask, "array<tinyint>")(F.col("pieces")).alias("loss_mask"),
        )

    def read(self, blocks: DataFrame) -> DataFrame:
        """Per conversation what its tokens say: number of turns, digest of all turns, length and digest of
        the text under the loss mask, and length of the formatted text, in code points."""
        kind = blocks.schema["conv_id"].dataType.simpleString()
        ordered = blocks.select("conv_id", "block", "ids", "loss_mask").repartition("conv_id")
        reader = _read(self.tokenizer.name, self.start, self.stop, self.line_end)
        return ordered.sortWithinPartitions("conv_id", "block").mapInArrow(
            reader,
            f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
            "formatted_chars bigint",
        )


def _mask(blocks: pa.Array) -> pa.Array:
    """The running sum of the marks of a block's pieces; marks outside a piece count at its edges."""
    out = []
    for pieces in blocks:
        total = []
        for p in pieces.as_py():
            marks = np.zeros(len(p["ids"]) + 1, np.int8)
            marks[min(max(p["rise"], 0), len(p["ids"]))] += 1
            marks[min(max(p["fall"], 0), len(p["ids"]))] -= 1
            total.append(np.cumsum(marks, dtype=np.int8)[:-1])
        out.append(np.concatenate(total))
    return pa.array(out, pa.list_(pa.int8()))


class _Conversation:
    """What has been read of one conversation."""

    def __init__(self, tokens: bpe.Tokens, start: int, stop: int, line_end: int):
        self.tokens, self.start, self.stop, self.line_end = tokens, start, stop, line_end
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.ids: list[np.ndarray] = []
        self.mask: list[np.ndarray] = []

    def text(self, ids: np.ndarray) -> bytes:
        return self.tokens.decode(ids, np.array([0, len(ids)]))[0]

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        """Read on; turns that end in this block are done with."""
        ends = np.flatnonzero(ids == self.stop)
        at = 0
        for end in ends.tolist():
            self.ids.append(ids[at:end])
            self.mask.append(mask[at:end])
            self.turn(np.concatenate(self.ids), np.concatenate(self.mask))
            self.ids, self.mask, at = [], [], end + 1
        self.ids.append(ids[at:])
        self.mask.append(mask[at:])

    def turn(self, ids: np.ndarray, mask: np.ndarray) -> None:
        if self.n_turns:  # the line end after the last turn's mark
            if ids[0] != self.line_end:
                raise ValueError("a turn does not end with a line end")
            ids, mask = ids[1:], mask[1:]
        head = int(np.argmax(ids == self.line_end))
        if ids[0] != self.start or ids[head] != self.line_end:
            raise ValueError("a turn does not begin with its mark and role")
        role, text = self.text(ids[1:head]), self.text(ids[head + 1 :])
        learned = unescape(self.text(ids[mask != 0]))
        self.turns.update(unescape_role(role) + b"\n" + unescape(text) + b"\n")
        self.loss.update(learned)
        self.n_turns += 1
        self.loss_chars += chars(learned)
        self.formatted_chars += len(START) + chars(role) + 1 + chars(text) + len(STOP) + 1

    def row(self, conv) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _read(name: str, start: int, stop: int, line_end: int):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.load(SparkFiles.get(name))
        current, conv, done, kind = None, None, [], None

        def out() -> pa.RecordBatch:
            columns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds])], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for i, c in enumerate(batch.column(0).to_pylist()):
                if current is None or c != conv:
                    if current is not None:
                        done.append(current.row(conv))
                    current, conv = _Conversation(tokens, start, stop, line_end), c
                ids, mask = batch.column(2)[i].values, batch.column(3)[i].values
                current.add(ids.to_numpy(), mask.to_numpy())
            if done:
                yield out()
                done = []
        if current is not None:
            done.append(current.row(conv))
            yield out()

    return run
