"""Byte-level BPE, with frequent words compiled into a minimal acyclic transducer.

Words are counted over all documents, in a sketch of bounded size per task, so the lexicon holds the
frequent ones. Which words it holds changes the speed only: any other word is merged exactly, pair by
pair. The lexicon is an automaton over bytes whose equal suffixes are shared; numbers on its arcs add
up to a word's place in the list of ids. It is laid out with the merge rules and token bytes in one
file that Spark brings to every executor, where the tasks of a machine map the same pages.

In a task, the different words of a slice of text walk the automaton together, byte by byte; those it
does not know are merged together, one merge each per step.

Defined results: null is an empty text, which has no ids; added tokens in a text become their ids, as
the tokenizers library does by default; ids decode to text as UTF-8, where bytes that are not are
replaced. Letters, digits and white space follow this Python's Unicode tables.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.llm import frames
from metricspark.llm.texts import END, LETTER, MARK, OTHER, SPACE, codes, kinds, pieces, span_hashes

LEXICON = 1 << 16
# Words of more bytes are left to the merges, and are not counted.
LONGEST = 40
# Words a task keeps while it counts.
COUNTED = 1 << 15
# Code points encoded at once.
SLICE = 1 << 19
# Words of more bytes are merged with a queue, shorter ones side by side.
QUEUED = 128

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# -- tables ------------------------------------------------------------------------------------


def hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots for different non-negative keys: the key in each slot or -1, and its place in `keys`."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, places = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    todo = np.arange(len(keys))
    at = ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
    while len(todo):
        free = slots[at] < 0
        slots[at[free]] = keys[todo[free]]
        won = slots[at] == keys[todo]
        places[at[won]] = todo[won]
        todo, at = todo[~won], (at[~won] + 1) & (len(slots) - 1)
    return slots, places


def find(slots: np.ndarray, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 if it has none."""
    bits = len(slots).bit_length() - 1
    at = ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
    held = slots[at]
    out = np.where(held == keys, places[at], -1)
    open_ = np.flatnonzero((held != keys) & (held >= 0))
    while len(open_):
        at[open_] = (at[open_] + 1) & (len(slots) - 1)
        held = slots[at[open_]]
        hit = held == keys[open_]
        out[open_[hit]] = places[at[open_[hit]]]
        open_ = open_[~hit & (held >= 0)]
    return out


def _byte_chars() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if it prints, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> dict[str, Any]:
    """Merge rules, token bytes and added tokens of a tokenizer file, as arrays."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    chars = _byte_chars()
    byte_of = {c: b for b, c in enumerate(chars)}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(byte_of[c] for c in token)
    for token, i in added.items():
        tokens[i] = token.encode()
    pairs, merged = [], []
    for rule in spec["model"]["merges"]:
        a, b = rule.split(" ") if isinstance(rule, str) else rule
        pairs.append(vocab[a] << 24 | vocab[b])
        merged.append(vocab[a + b])
    slots, ranks = hash_table(np.array(pairs, np.int64))
    return {
        "pair_slots": slots,
        "pair_ranks": ranks,
        "merged": np.array(merged, np.int32),
        "byte_ids": np.array([vocab[c] for c in chars], np.int32),
        "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
        "token_at": np.cumsum([0, *map(len, tokens)]).astype(np.int64),
        "added": added,
    }


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted, different words, with numbers on its arcs.

    States are frozen from the end of each word as soon as no later word can pass through them, and a
    frozen state that equals an earlier one gives way to it. The number of an arc is how many words
    leave the state before it, so a word's numbers add up to its place.
    """
    frozen: dict[tuple, int] = {}
    arcs: list[tuple] = []  # by state: (byte, target) pairs
    final: list[bool] = []
    below: list[int] = []  # words from a state on

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in frozen:
            frozen[key] = len(arcs)
            arcs.append(key[1])
            final.append(node[0])
            below.append(node[0] + sum(below[t] for _, t in key[1]))
        return frozen[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in [*words, b""]:
        same = os.path.commonprefix([last, word])
        for i in range(len(last), len(same), -1):
            path[i - 1][1].append((last[i - 1], freeze(path.pop())))
        for _ in word[len(same) :]:
            path.append([False, []])
        path[len(word)][0] = bool(word)
        last = word
    path[0][0] = False
    start = freeze(path[0])
    keys, targets, numbers = [], [], []
    for state, out in enumerate(arcs):
        number = int(final[state])
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(number)
            number += below[target]
    slots, places = hash_table(np.array(keys, np.int64))
    return {
        "arc_slots": slots,
        "arc_places": places,
        "arc_targets": np.array(targets, np.int32),
        "arc_numbers": np.array(numbers, np.int32),
        "final": np.array(final, bool),
        "start": np.array([start], np.int32),
    }


def save(path: str, arrays: dict[str, np.ndarray], added: dict[str, int]) -> None:
    """Arrays one after the other in one file, with a header of names, types and places."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    header = json.dumps({"arrays": places, "added": added}).encode()
    with open(path, "wb") as f:
        f.write(len(header).to_bytes(8, "little") + header)
        f.write(b" " * (-f.tell() % 64))
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(b" " * (-f.tell() % 64))


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokens:
    mapped = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(mapped[:8].tobytes(), "little")
    header = json.loads(mapped[8 : 8 + size].tobytes())
    begin = -(-(8 + size) // 64) * 64
    arrays = {}
    for name, (kind, n, at) in header["arrays"].items():
        dtype = np.dtype(kind)
        arrays[name] = mapped[begin + at : begin + at + n * dtype.itemsize].view(dtype)
    return Tokens(arrays, header["added"])


# -- words -------------------------------------------------------------------------------------


def token_spans(cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that merges stay within. `ends` are places that belong to no text.

    A word is a run of letters, of digits or of other characters, with one blank before it; white
    space before such a blank, or before another character, is a word of its own, and so are English
    clitics after an apostrophe.
    """
    kind = kinds()[cps]
    kind[kind == MARK] = OTHER
    kind[ends] = END
    start = np.ones(len(cps) + 1, bool)
    start[1:-1] = kind[1:] != kind[:-1]
    following = np.concatenate([kind[1:], [END]])
    last = np.flatnonzero((kind == SPACE) & (following != SPACE) & (following != END))
    start[last] = True
    start[last[cps[last] == 32] + 1] = False
    quote = np.flatnonzero((cps == 39) & start[:-1] & (following == LETTER))
    if len(quote):
        padded = np.concatenate([cps, np.zeros(3, cps.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        pairs = {("l", "l"), ("v", "e"), ("r", "e")}
        length = np.where(np.isin(one, [ord(c) for c in "sdmt"]), 1, 0)
        for a, b in pairs:
            length = np.where((one == ord(a)) & (two == ord(b)), 2, length)
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        rest = quote + 1 + length
        rest = rest[rest < len(cps)]
        start[rest[kind[rest] == LETTER]] = True
    edges = np.flatnonzero(start)
    if edges[-1] != len(cps):
        edges = np.append(edges, len(cps))
    begin, end = edges[:-1], edges[1:]
    own = kind[begin] != END
    return begin[own], end[own]


class Slice:
    """Some texts with their different words."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts)
        cps = codes(joined)
        self.bytes = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        lengths = np.array([len(t) for t in texts])
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        start, end = token_spans(cps, self.begin[1:-1] - 1) if len(cps) else (np.zeros(0, int), np.zeros(0, int))
        width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        _, self.first, self.which = np.unique(span_hashes(cps, start, end), return_index=True, return_inverse=True)
        self.word_start, self.word_end = byte_at[start[self.first]], byte_at[end[self.first]]
        # where each text's words begin among all words
        self.text_at = np.searchsorted(start, self.begin)


class Tokens:
    """A vocabulary, and a lexicon if there is one."""

    def __init__(self, arrays: dict[str, np.ndarray], added: dict[str, int]):
        self.a, self.added = arrays, added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    # words to ids

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's place in the lexicon, -1 if it is not there; all words take a step at a time."""
        a = self.a
        place = np.full(len(start), -1, np.int64)
        live = np.flatnonzero((end > start) & (end - start <= LONGEST))
        state = np.full(len(live), a["start"][0], np.int64)
        number = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            arc = find(a["arc_slots"], a["arc_places"], state << 8 | data[start[live] + step])
            known = arc >= 0
            live, arc = live[known], arc[known]
            state, number = a["arc_targets"][arc].astype(np.int64), number[known] + a["arc_numbers"][arc]
            step += 1
            ended = end[live] - start[live] == step
            word = ended & a["final"][state]
            place[live[word]] = number[word]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return place

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each word by the merge rules: words with as many ids each, and a row of ids for each."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        lengths = end - start
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            if n > QUEUED:
                out.extend((which[i : i + 1], self._merge_long(data[start[w] : end[w]])[None]) for i, w in enumerate(which))
                continue
            ids = self.a["byte_ids"][data[start[which][:, None] + np.arange(n)]].astype(np.int64)
            while len(which) and ids.shape[1] > 1:
                ranks = find(self.a["pair_slots"], self.a["pair_ranks"], (ids[:, :-1] << 24 | ids[:, 1:]).ravel())
                ranks = np.where(ranks < 0, 1 << 30, ranks).reshape(len(which), -1)
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(which)), best]
                done = rank == 1 << 30
                if done.any():
                    out.append((which[done], ids[done]))
                    which, ids, best, rank = which[~done], ids[~done], best[~done], rank[~done]
                ids[np.arange(len(which)), best] = self.a["merged"][rank]
                keep = np.ones(ids.shape, bool)
                keep[np.arange(len(which)), best + 1] = False
                ids = ids[keep].reshape(len(which), ids.shape[1] - 1)
            if len(which):
                out.append((which, ids))
        return out

    def _rank(self, left: int, right: int) -> int:
        return int(find(self.a["pair_slots"], self.a["pair_ranks"], np.array([left << 24 | right]))[0])

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """One long word, with a queue of pairs: the time grows with n log n."""
        ids = self.a["byte_ids"][data].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            pair = (ids[i], ids[after[i]])
            if pair not in known:
                known[pair] = self._rank(*pair)
            return known[pair]

        queue = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(i)) >= 0]
        heapq.heapify(queue)
        while queue:
            r, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.a["merged"][r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rank(k)) >= 0:
                    heapq.heappush(queue, (r, k, ids[k], ids[after[k]]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def word_ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's begin."""
        a = self.a
        place = self.look_up(data, start, end) if "start" in a else np.full(len(start), -1)
        known = place >= 0
        other = np.flatnonzero(~known)
        merged = self.merge(data, start[other], end[other])
        counts = np.zeros(len(start), np.int64)
        if known.any():
            counts[known] = a["lexicon_at"][place[known] + 1] - a["lexicon_at"][place[known]]
        for which, rows in merged:
            counts[other[which]] = rows.shape[1]
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(int(at[-1]), np.int32)
        if known.any():
            from_lexicon = a["lexicon_ids"][spread(a["lexicon_at"][place[known]], counts[known])]
            ids[spread(at[:-1][known], counts[known])] = from_lexicon
        for which, rows in merged:
            ids[at[other[which]][:, None] + np.arange(rows.shape[1])] = rows
        return ids, at

    # texts to ids and back

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        parts: list[tuple[int, str, int]] = []  # text number, ordinary text, id of the added token before it
        for i, text in enumerate(texts):
            split = self.split.split(text or "") if self.added else [text or ""]
            parts.append((i, split[0], -1))
            parts.extend((i, split[k + 1], self.added[split[k]]) for k in range(1, len(split), 2))
        ids: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        seen = -1
        for group in pieces([p[1] for p in parts], SLICE):
            cut = Slice([p for _, p in group])
            flat, at = self.word_ids(cut.bytes, cut.word_start, cut.word_end)
            counts = np.diff(at)[cut.which]
            total = np.concatenate([[0], np.cumsum(counts)])
            out = flat[spread(at[:-1][cut.which], counts)]
            which = np.array([parts[k][0] for k, _ in group], np.int64)
            numbers_of = np.repeat(which, np.diff(total[cut.text_at]))
            extra, where = [], []
            for n, (k, _) in enumerate(group):
                if k != seen and parts[k][2] >= 0:
                    extra.append((parts[k][2], parts[k][0]))
                    where.append(total[cut.text_at[n]])
                seen = k
            if extra:
                out = np.insert(out, where, [e[0] for e in extra])
                numbers_of = np.insert(numbers_of, where, [e[1] for e in extra])
            ids.append(out)
            numbers.append(numbers_of)
        every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        return (
            np.concatenate(ids) if ids else np.zeros(0, np.int32),
            np.searchsorted(every, np.arange(len(texts) + 1)),
        )

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        counts = np.diff(self.a["token_at"])[ids]
        data = self.a["token_bytes"][spread(self.a["token_at"][ids], counts)].tobytes()
        end = np.concatenate([[0], np.cumsum(counts)])[at]
        return [data[i:j] for i, j in zip(end, end[1:])]


def spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for counts[i] places each."""
    total = np.cumsum(counts)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(start - (total - counts), counts)


# -- Spark -------------------------------------------------------------------------------------


def _counted(most: int):
    """(word, n) of a task's frequent words: of more than 4 * most words, the most frequent `most` go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in frames.slices(batches, 0, SLICE):
            for group in pieces(batch.column(0).to_pylist(), SLICE):
                cut = Slice([p for _, p in group])
                data, counts = cut.bytes.tobytes(), np.bincount(cut.which, minlength=len(cut.first))
                short = np.flatnonzero(cut.word_end - cut.word_start <= LONGEST)
                spans = zip(cut.word_start[short].tolist(), cut.word_end[short].tolist(), counts[short].tolist())
                for i, j, n in spans:
                    total[data[i:j]] += n
                if len(total) > 4 * most:
                    total = Counter(dict(total.most_common(most)))
        words = total.most_common(most)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in words], pa.binary()), pa.array([n for _, n in words], pa.int64())],
            names=["word", "n"],
        )

    return run


def frequent_words(texts: DataFrame, text_col: str, most: int = LEXICON, counted: int = COUNTED) -> list[bytes]:
    """The most frequent words of all texts, about `most` at most, which bounds what the driver gets.

    Words are first counted per sixteenth of a power of two of their frequency, some hundred rows; of the lowest such
    class that fits in part, words are taken by their hash.
    """
    words = frames.stage(
        texts.select(F.col(text_col).cast("string"))
        .mapInArrow(_counted(counted), "word binary, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .withColumn("class", F.floor(F.log2("n") * 16).cast("int")),
        "words",
    )
    taken, least, share = 0, None, 0.0
    for r in sorted(words.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if taken + r["n"] > most:
            share = (most - taken) / r["n"]
        taken, least = taken + r["n"], r["class"]
        if taken >= most:
            break
    if least is None:
        return []
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < (share or 1.0) * (1 << 20)
    rows = words.where((F.col("class") > least) | (F.col("class") == least) & part).select("word").collect()
    return sorted(bytes(r.word) for r in rows)


_brought: set[tuple[str, str]] = set()


class Bpe:
    """Encoder and decoder columns for one vocabulary and lexicon."""

    def __init__(
        self, spark: SparkSession, path: str, words: list[bytes] | None = None, reserved: tuple[str, ...] = ()
    ):
        """`reserved` strings get the ids after the vocabulary's; texts never become them, only ids do."""
        arrays = read_vocabulary(path)
        added = arrays.pop("added")
        first = len(arrays["token_at"]) - 1
        self.reserved = {token: first + i for i, token in enumerate(reserved)}
        lengths = np.cumsum([len(token.encode()) for token in reserved]).astype(np.int64)
        arrays["token_bytes"] = np.concatenate([arrays["token_bytes"], np.frombuffer("".join(reserved).encode(), np.uint8)])
        arrays["token_at"] = np.concatenate([arrays["token_at"], arrays["token_at"][-1] + lengths])
        words = [w for w in words or [] if w]
        if words:
            data = np.frombuffer(b"".join(words), np.uint8)
            end = np.cumsum([len(w) for w in words])
            ids, at = Tokens(arrays, added).word_ids(data, end - [len(w) for w in words], end)
            arrays |= compile_words(words) | {"lexicon_ids": ids, "lexicon_at": at}
        folder = tempfile.mkdtemp(prefix="lexicon-")  # the driver's own; Spark brings the file to the executors
        local = os.path.join(folder, "lexicon")
        save(local, arrays, added)
        with open(local, "rb") as f:
            self.name = f"lexicon-{hashlib.file_digest(f, 'sha256').hexdigest()[:32]}"
        context = spark.sparkContext
        if (context.applicationId, self.name) not in _brought:  # the name tells the content
            os.rename(local, os.path.join(folder, self.name))
            context.addFile(os.path.join(folder, self.name))
            _brought.add((context.applicationId, self.name))

    def encode(self, text: Column) -> Column:
        """The ids of a text."""
        name = self.name  # the functions below hold the name alone; the file comes with Spark

        def run(texts: pa.Array) -> pa.Array:
            tokens, ids, ends = load(SparkFiles.get(name)), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for start, length in frames.spans(texts, SLICE):
                some, at = tokens.encode(texts.slice(start, length).to_pylist())
                ids.append(some)
                ends.append(ends[-1][-1] + at[1:])
            return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)))

        return F.arrow_udf(run, "array<int>").asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        """The text of ids; null is empty."""
        name = self.name

        def run(lists: pa.Array) -> pa.Array:
            tokens, out = load(SparkFiles.get(name)), []
            for x in lists:
                ids = x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(0, np.int64)
                out.append(tokens.decode(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace"))
            return pa.array(out, pa.string())

        return F.arrow_udf(run, "string")(ids)


def digest_ids(ids: Column) -> Column:
    """Lower-case hex SHA-256 of ids as little-endian unsigned 32-bit integers."""

    def run(lists: pa.Array) -> pa.Array:
        return pa.array(
            [hashlib.sha256(np.asarray(x.values, dtype="<u4").tobytes()).hexdigest() for x in lists], pa.string()
        )

    return F.arrow_udf(run, "string")(ids)


def with_lexicon(docs: DataFrame, text_col: str, path: str) -> Bpe:
    """A tokenizer whose lexicon holds the frequent words of these texts."""
    return Bpe(docs.sparkSession, path, frequent_words(docs, text_col))
