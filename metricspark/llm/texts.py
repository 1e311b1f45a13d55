"""Code points, words and shingles of many texts at once, as numpy arrays inside tasks.

A word is a maximal run of letters, marks and digits, lower-cased by the one-to-one mapping of its
code points; everything else separates words. Word and shingle hashes are 64 bits wide, depend on
nothing but the text, and are the same in every process.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

OTHER, LETTER, NUMBER, SPACE, MARK, END = range(6)

# Longer texts, in code points, are cut where white space begins.
CHUNK = 1 << 20
# Code points handled at once: as many texts as fill it, or one piece of a text.
TOGETHER = 1 << 17

_WORD_END = re.compile(r"\S\s")

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point; white space is Unicode's White_Space."""
    initial = {"L": LETTER, "N": NUMBER, "M": MARK}
    kind = np.array([initial.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kind


@functools.cache
def lowered() -> np.ndarray:
    """The lower case of every code point that has one of a single code point."""
    low = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if len(small := c.lower()) == 1 and small != c:
            low[i] = ord(small)
    return low


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, U64), np.full(n, _BASE_INVERSE, U64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    return _powers(max(2 * TOGETHER, 1 << max(0, n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, all from one running sum."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def pieces(texts: Sequence[str | None], chunk: int = CHUNK, together: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """Groups of (text number, piece) of about `together` code points, in order, no piece much longer than `chunk`, which
    is also what `together` is unless given; None is an empty text."""
    together = chunk if together is None else together
    group, size = [], 0
    for i, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = len(text)
            if end - at > chunk:
                cut = at + chunk
                while cut > at and not (text[cut].isspace() and not text[cut - 1].isspace()):
                    cut = max(text.rfind(" ", at, cut), text.rfind("\n", at, cut), at)
                if cut == at:  # nothing to cut at within the piece: it grows to the next such place
                    found = _WORD_END.search(text, at + chunk - 1)
                    cut = found.start() + 1 if found else end
                end = cut
            group.append((i, text[at:end]))
            size += end - at + 1
            at = end
            if size >= together:
                yield group
                group, size = [], 0
            if at >= len(text):
                break
    if group:
        yield group


def word_spans(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = kinds()[cps]
    inside = np.zeros(len(cps) + 2, bool)
    inside[1:-1] = (kind == LETTER) | (kind == NUMBER) | (kind == MARK)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more than texts)."""
    hashes, numbers = [], []
    for group in pieces(texts, together=TOGETHER):
        cps = codes("\n".join(p for _, p in group))
        begin = np.cumsum([0, *(len(p) + 1 for _, p in group)])
        starts, ends = word_spans(cps)
        hashes.append(span_hashes(lowered()[cps], starts, ends))
        which = np.searchsorted(begin, starts, "right") - 1
        numbers.append(np.array([i for i, _ in group], np.int64)[which])
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    numbers = np.concatenate(numbers)
    return np.concatenate(hashes), np.searchsorted(numbers, np.arange(len(texts) + 1))


def shingle_hashes(words: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row, per text; a text of fewer words has one shingle of them all."""
    counts = np.diff(begin)
    lengths = np.minimum(counts, k)
    n = np.where(counts > 0, counts - lengths + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)])
    # a shingle is the run of `length` word hashes from its first word on
    first = np.arange(out[-1]) - np.repeat(out[:-1] - begin[:-1], n)
    total = np.zeros(int(out[-1]), U64)
    length = np.repeat(lengths, n)
    factor = 1
    for j in range(k):
        here = length > j
        if here.all():
            total += words[first + j] * U64(factor)
        else:
            total[here] += words[first[here] + j] * U64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total + length.astype(U64)), out
