"""Benchmark decontamination by templates: finds items also where their numbers, names or units changed.

A text becomes tokens: words in lower case, and typed placeholders for numbers (3, 1,250.5), names
(capitalised words, those in a row are one name) and units after a number (3 kg, 3kg). As a capital may
also be due to the sentence, texts have up to three readings: without names, with the capitalised words
inside sentences as names, and with all capitalised words. A copy in one case meets the reading without
names. In lines without capitalised words any one word of a window may be a name: such a window
has a hash for each. Every window of `k` tokens has a hash; windows with fewer than two words hash what the
placeholders stand for instead, as a row of placeholders alone says nothing. The windows of the benchmark are hash-joined with those of
all documents inside the tasks that read the documents, so a passage that a third of the documents hold
is no group anywhere. Of each match, the places that line up are checked slot by slot: along one
alignment, a value of the item must always have become the same value in the document, and windows with
a slot that breaks this do not count. A document holds an item if the windows that count, in whichever
reading, are at least `coverage` of the item's in one reading, or if a run of such windows, one token on
from each other, is `run` tokens long, whatever share of a long item that is.

The benchmark goes to the tasks in blocks of about `block_words` words, which bounds what is broadcast;
a larger benchmark takes more passes over the documents.

Items of fewer than `k` tokens are looked up by windows of their own length, with literal values where
fewer than three words are left.

Defined results: null and empty texts and items match nothing; a text or item of fewer than `k` tokens
is one window of them all; an item of one word is in every text with that word; repeated rows are checked one by one; items with the same text are all found;
a null item id is reported as null. Texts of over a million characters are read in pieces cut where
white space begins: a name of two words across a cut counts as two. Not found are changed names of two
words, or two different ones in one window, in lines without capitalised words.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.llm.texts import (
    NUMBER,
    TOGETHER,
    U64,
    codes,
    kinds,
    lowered,
    pieces,
    shingle_hashes,
    span_hashes,
    word_spans,
)

WORDS = 5
COVERAGE = 0.5
RUN = 13
BLOCK_WORDS = 1_000_000

WORD, NUM, NAME, UNIT = range(4)
_PLACEHOLDER = np.array([0, 0x1B873593A5A5, 0xE6546B64C3C3, 0x85EBCA6B9696], U64)
_LITERAL = U64(0x2545F4914F6CDD1D)
_SHORT = U64(0x9FB21C651E98DF25)

# fixed values: units of measure and money, lower-cased
UNITS = """
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilo kilos t ton tons
tonne tonnes lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons s sec second
seconds min minute minutes h hour hours day days week weeks month months year years percent degree degrees mph
kmh kph hz khz mhz ghz w kw mw v volt volts j kj cal kcal usd eur gbp dollar dollars cent cents euro euros
rupee rupees yen peso pesos
"""


def _unit_hashes() -> np.ndarray:
    words = UNITS.split()
    cps = codes(" ".join(words))
    return np.sort(span_hashes(lowered()[cps], *word_spans(cps)))


# readings of a text: no names; capitalised words inside sentences are names; all capitalised words are
PLAIN, INSIDE, ALL = range(3)


@functools.cache
def _cased() -> np.ndarray:
    """Which code points have another case."""
    low = lowered()
    cased = low != np.arange(len(low))
    cased[low[cased]] = True
    return cased


class Reading(NamedTuple):
    """Tokens of all texts in order: hash of the word or placeholder, hash of what stands there, kind, number
    of the token in the text's finest reading, whether the word may be a name (PLAIN only); where each
    text's tokens begin; and which texts differ in this reading from the one before."""

    tokens: np.ndarray
    values: np.ndarray
    kind: np.ndarray
    base: np.ndarray
    wild: np.ndarray
    begin: np.ndarray
    own: np.ndarray


def template(texts: list[str | None]) -> list[Reading]:
    """The readings PLAIN, INSIDE and ALL of all texts."""
    units = _unit_hashes()
    parts: list[list[tuple[np.ndarray, ...]]] = [[], [], []]
    own = np.zeros((3, len(texts)), bool)
    own[PLAIN] = True
    seen = -1
    for group in pieces(texts, together=TOGETHER):
        cps = codes("\n".join(p for _, p in group))
        if not len(cps):
            continue
        low = lowered()[cps]
        start, end = word_spans(cps)
        if not len(start):
            continue
        # 3kg is 3 and kg
        others = np.append(np.flatnonzero(kinds()[cps] != NUMBER), len(cps))
        cut = np.minimum(others[np.searchsorted(others, start)], end)
        mixed = np.flatnonzero((cut > start) & (cut < end))
        value = span_hashes(low, cut[mixed], end[mixed])
        cut = cut[mixed[units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value]]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        begin = np.cumsum([0, *(len(p) + 1 for _, p in group)])
        which = np.searchsorted(begin, start, "right") - 1
        opens = np.concatenate([[True], which[1:] != which[:-1]])  # first word of its piece
        gap_at = np.where(opens, begin[which], np.concatenate([[0], end[:-1]]))
        stops = np.concatenate([[0], np.cumsum(np.isin(cps, [ord(c) for c in ".!?:\n"]))])
        continued = group[0][0] == seen
        sentence = (stops[start] > stops[gap_at]) | (opens & ~((which == 0) & continued))
        seen = group[-1][0]
        numbers = np.array([i for i, _ in group], np.int64)[which]
        number = kinds()[cps[start]] == NUMBER
        second = np.minimum(start + 1, len(cps) - 1)
        capital = (low[start] != cps[start]) & (end - start > 1) & (low[second] == cps[second]) & ~np.isin(start, cut)
        own[INSIDE, numbers[capital & ~sentence]] = True
        own[ALL, numbers[capital & sentence]] = True
        # in lines without such words a name may be written like other words
        line = np.cumsum(cps == 10)[start]
        wild = _cased()[cps[start]] & ~np.isin(line, line[capital])
        follows = np.concatenate([[False], start[1:] - end[:-1] == 1]) & ~opens
        between = cps[np.maximum(start - 1, 0)]
        before = lambda flags: np.concatenate([[False], flags[:-1]])
        joined = follows & number & before(number) & np.isin(between, [ord("."), ord(",")])
        finest = np.cumsum(~joined) - 1 + (parts[PLAIN][-1][3][-1] + 1 if parts[PLAIN] else 0)
        for reading, name in ((PLAIN, np.zeros(len(start), bool)), (INSIDE, capital & ~sentence), (ALL, capital)):
            heads = np.flatnonzero(~(joined | (follows & name & before(name) & (between == 32))))
            tails = np.append(heads[1:], len(start)) - 1
            value = span_hashes(low, start[heads], end[tails])
            kind = np.where(number[heads], NUM, np.where(name[heads], NAME, WORD))
            at = np.minimum(np.searchsorted(units, value), len(units) - 1)
            after_number = np.concatenate([[False], kind[:-1] == NUM]) & ~opens[heads]
            kind = np.where((units[at] == value) & after_number, UNIT, kind).astype(np.uint8)
            tokens = np.where(kind == WORD, value, _PLACEHOLDER[kind])
            may = wild[heads] & (kind == WORD) & (reading == PLAIN)
            parts[reading].append((tokens, value, kind, finest[heads], may, numbers[heads]))
    empty = tuple(np.zeros(0, t) for t in (U64, U64, np.uint8, np.int64, bool, np.int64))
    out = []
    for reading, found in enumerate(parts):
        *columns, numbers = (np.concatenate(x) for x in zip(*(found or [empty])))
        at = np.searchsorted(numbers, np.arange(len(texts) + 1))
        out.append(Reading(*columns, at, own[reading]))
    return out


class Windows(NamedTuple):
    """Hashes of windows, and of each its reading, text, and first token counted from the text's first."""

    hashes: np.ndarray
    reading: np.ndarray
    text: np.ndarray
    place: np.ndarray


def windows(readings: list[Reading], k: int) -> tuple[Windows, np.ndarray]:
    """Every k tokens in a row of every reading of its own that a text has, also with each word that may be
    a name as one; and how many places for windows each text has in each reading."""
    rows: list[tuple[np.ndarray, ...]] = []
    counts = np.zeros((3, len(readings[0].begin) - 1), np.int64)
    for number, r in enumerate(readings):
        typed, at = shingle_hashes(r.tokens, r.begin, k)
        literal, _ = shingle_hashes(r.values, r.begin, k)
        counts[number] = np.where(r.own, np.diff(at), 0)
        text = np.repeat(np.arange(len(r.own)), np.diff(at))
        place = np.arange(at[-1]) - at[:-1][text]
        first = place + r.begin[:-1][text]
        last = np.minimum(first + k, r.begin[1:][text])
        words = np.concatenate([[0], np.cumsum(r.kind == WORD)])
        words = words[last] - words[first]
        keep = r.own[text]
        rows.append((np.where(words >= 2, typed, literal ^ _LITERAL)[keep], text[keep], place[keep], number))
        for j in range(k if r.wild.any() else 0):
            free = np.flatnonzero((words >= 3) & (first + j < last))
            free = free[r.wild[first[free] + j]]
            if len(free):
                named, hashes = _with_name(r, first[free], last[free], j)
                rows.append((hashes, text[free[named]], place[free[named]], number))
    reading = np.concatenate([np.full(len(h), number) for h, _, _, number in rows])
    hashes, text, place = (np.concatenate([x[c] for x in rows]) for c in range(3))
    return Windows(hashes, reading, text, place), counts


def short_windows(readings: list[Reading], lengths: Iterable[int], whole: bool) -> Windows:
    """Every window of these lengths, of `whole` those that are all of a text, with literal values where
    fewer than three words are left."""
    rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)]
    for number, r in enumerate(readings):
        sizes = np.diff(r.begin)
        words = np.concatenate([[0], np.cumsum(r.kind == WORD)])
        for m in lengths:
            typed, at = shingle_hashes(r.tokens, r.begin, m)
            literal, _ = shingle_hashes(r.values, r.begin, m)
            text = np.repeat(np.arange(len(r.own)), np.diff(at))
            keep = np.flatnonzero(r.own[text] & ((sizes == m) if whole else (sizes >= m))[text])
            text, place = text[keep], keep - at[:-1][text[keep]]
            first = place + r.begin[:-1][text]
            enough = words[first + m] - words[first] >= 3
            hashes = np.where(enough, typed[keep], literal[keep] ^ _LITERAL) ^ _SHORT
            rows.append((hashes, np.full(len(text), number), text, place))
    return Windows(*(np.concatenate(x) for x in zip(*rows)))


def _with_name(r: Reading, first: np.ndarray, last: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows first:last keep two words when the j-th, wherever it stands in them, is a name, and
    these windows' hashes."""
    at = first[:, None] + np.arange(int((last - first).max()))
    inside = at < last[:, None]
    at = np.minimum(at, len(r.tokens) - 1)
    name = inside & (r.kind[at] == WORD) & (r.values[at] == r.values[first + j][:, None])
    named = np.flatnonzero((inside & (r.kind[at] == WORD) & ~name).sum(axis=1) >= 2)
    taken = np.where(name, _PLACEHOLDER[NAME], r.tokens[at])[named]
    begin = np.concatenate([[0], np.cumsum((last - first)[named])])
    hashes, _ = shingle_hashes(taken[inside[named]], begin, inside.shape[1])
    return named, hashes


def _both(a: Windows, b: Windows) -> Windows:
    return Windows(*(np.concatenate(x) for x in zip(a, b)))


class Benchmark:
    """The windows of some items, sorted by hash, with the items' tokens."""

    def __init__(self, texts: list[str | None], k: int, run: int = RUN):
        self.k, self.run = k, run
        self.readings = template(texts)
        found, self.counts = windows(self.readings, k)
        # items of fewer than k tokens are looked up by windows of their own lengths
        sizes = np.concatenate([np.diff(r.begin)[r.own] for r in self.readings])
        self.short = np.unique(sizes[(sizes > 0) & (sizes < k)]).tolist()
        found = _both(found, short_windows(self.readings, self.short, whole=True))
        order = np.argsort(found.hashes, kind="stable")
        self.hashes, self.reading, self.item, self.place = (x[order] for x in found)
        # the item's tokens that windows begin with, by the finest reading
        begin = np.array([r.begin for r in self.readings])
        base = [r.base for r in self.readings]
        self.base = np.zeros(len(order), np.int64)
        for number in range(3):
            rows = self.reading == number
            self.base[rows] = base[number][begin[number, self.item[rows]] + self.place[rows]]
        bits = max(16, int(16 * len(order)).bit_length())
        self.shift = U64(64 - min(bits, 26))
        self.maybe = np.zeros(1 << min(bits, 26), bool)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def search(self, texts: list[str | None], coverage: float) -> list[list[tuple[int, int, int, int]]]:
        """Per text (item, its windows, those that count, slots that changed)."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        readings = template(texts)
        theirs, _ = windows(readings, self.k)
        if self.short:
            theirs = _both(theirs, short_windows(readings, self.short, whole=False))
        if not len(self.hashes) or not len(theirs.hashes):
            return found
        near = np.flatnonzero(self.maybe[(theirs.hashes >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.hashes, theirs.hashes[near], "left")
        n = np.searchsorted(self.hashes, theirs.hashes[near], "right") - low
        where = np.repeat(near, n)
        hit = np.arange(len(where)) + np.repeat(low - (np.cumsum(n) - n), n)
        if not len(hit):
            return found
        # different windows of an item that a text holds
        items = self.counts.shape[1]
        pair = theirs.text[where] * items + self.item[hit]
        first = int(self.base.max()) + 1
        different = np.unique(pair * first + self.base[hit]) // first
        pairs, covered = np.unique(different, return_counts=True)
        least = np.where(self.counts > 0, self.counts, np.iinfo(np.int64).max).min(axis=0)
        enough = pairs[covered >= np.minimum(coverage * least[pairs % items], max(1, self.run - self.k + 1))]
        order = np.argsort(pair, kind="stable")
        bounds = np.searchsorted(pair[order], np.stack([enough, enough + 1]))
        for p, lo, hi in zip(enough.tolist(), *bounds.tolist()):
            t, i = divmod(p, items)
            own = order[lo:hi]
            rows = np.stack([self.reading[hit[own]], theirs.reading[where[own]], theirs.place[where[own]], self.place[hit[own]]])
            values = [r.values[r.begin[t] : r.begin[t + 1]] for r in readings]
            count, good, changed, longest = self._consistent(i, rows, values)
            if good >= coverage * count or longest >= self.run:
                found[t].append((i, count, good, changed))
        return found

    def _consistent(self, i: int, rows: np.ndarray, values: list[np.ndarray]) -> tuple[int, int, int, int]:
        """How many windows item i has, how many of them match with slots that keep to one replacement per
        value, and how many of the item's values were replaced by others, in the reading where most match;
        and of how many tokens the longest run of such windows is."""
        longest = 0
        good: set[int] = set()
        changed: set[int] = set()
        reading, other, offset, place = rows
        alignments, which, sizes = np.unique(
            np.stack([reading, other, offset - place]), axis=1, return_inverse=True, return_counts=True
        )
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(sizes)
        starts = {}
        for number, r in enumerate(self.readings):
            if self.counts[number, i]:
                starts[number] = r.base[r.begin[i] : r.begin[i] + self.counts[number, i]]
        whole = set().union(*(s.tolist() for s in starts.values()))
        # alignments with the most windows come first; once all windows count, others add none
        for a in np.argsort(-sizes, kind="stable").tolist():
            number, their, shift = alignments[:, a].tolist()
            r, theirs = self.readings[number], values[their]
            begin, end = int(r.begin[i]), int(r.begin[i + 1])
            mine, kind, base = r.values[begin:end], r.kind[begin:end], r.base[begin:end]
            places = np.unique(place[order[ends[a] - sizes[a] : ends[a]]])
            inside = np.unique(places[:, None] + np.arange(self.k))
            inside = inside[inside < len(mine)]
            differs = inside[mine[inside] != theirs[inside + shift]]
            slots = inside[(kind[inside] != WORD) | np.isin(mine[inside], mine[differs[kind[differs] == WORD]])]
            became: dict[int, Counter] = {}
            for s in slots.tolist():
                became.setdefault(int(mine[s]), Counter())[int(theirs[s + shift])] += 1
            usual = {a: min(b, key=lambda v, b=b, a=a: (-b[v], v != a, v)) for a, b in became.items()}
            odd = np.array([s for s in slots.tolist() if usual[int(mine[s])] != int(theirs[s + shift])], np.int64)
            places = places[np.searchsorted(odd, places) == np.searchsorted(odd, places + self.k)]
            good.update(base[places].tolist())
            if len(places):
                breaks = np.flatnonzero(np.diff(places) != 1)
                lows, highs = places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)]
                # other words at a run's ends are not changed names
                same = inside[~((kind[inside] == WORD) & np.isin(inside, differs))]
                lows = np.searchsorted(same, lows)
                highs = np.searchsorted(same, highs + self.k) - 1
                longest = max(longest, int((same[highs] - same[np.minimum(lows, len(same) - 1)]).max()) + 1)
            kept = np.isin(differs, places[:, None] + np.arange(self.k))
            changed.update(mine[differs[kept]].tolist())
            if whole <= good:
                break
        matched = {number: sum(q in good for q in s.tolist()) for number, s in starts.items()}
        best = max(starts, key=lambda number: (matched[number] / len(starts[number]), number))
        return len(starts[best]), matched[best], len(changed), longest


def _search(held, coverage: float, id_type: pa.DataType):
    fields = [("item", id_type), ("windows", pa.int32()), ("matched", pa.int32()), ("changed", pa.int32())]

    def run(texts: pa.Array) -> pa.Array:
        ids, items = held.value
        out: list[list[dict]] = []
        group, size = [], 0
        for n, text in enumerate(texts, 1):
            group.append(text.as_py())
            size += len(group[-1] or "")
            if size >= TOGETHER or n == len(texts):
                for found in items.search(group, coverage):
                    out.append([dict(zip((f[0] for f in fields), (ids[i], *rest))) for i, *rest in found])
                group, size = [], 0
        return pa.array(out, pa.list_(pa.struct(fields)))

    return run


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = WORDS,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
    run: int = RUN,
) -> DataFrame:
    """`docs` with a column leaks: for every item a text holds, its id, how many windows it has, how many
    of them match, and how many of its numbers, names and units were changed. Ids that are not whole
    numbers come out as text."""
    whole = dict(benchmark.dtypes)[item_col] in ("tinyint", "smallint", "int", "bigint")
    id_type, arrow_type = ("bigint", pa.int64()) if whole else ("string", pa.string())
    items = benchmark.select(
        F.col(item_col).cast(id_type).alias("id"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    leaks: list[Column] = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r.id is None, r.id or 0 if whole else r.id or "", r.text))
        held = docs.sparkSession.sparkContext.broadcast(([r.id for r in rows], Benchmark([r.text for r in rows], k, run)))
        kind = f"array<struct<item:{id_type},windows:int,matched:int,changed:int>>"
        leaks.append(F.arrow_udf(_search(held, coverage, arrow_type), kind).asNondeterministic()(F.col(text_col)))
    texts = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return texts.withColumn("leaks", F.concat(*leaks) if len(leaks) > 1 else leaks[0])
