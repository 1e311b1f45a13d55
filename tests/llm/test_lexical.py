"""Ranked lexical search against scores of all documents, and the interval search against all scores of a block."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from metricspark.llm import lexical
from metricspark.llm.lexical import Item, Postings, search, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, q string, rank string, score string"


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, best=10):
    """Per item its ranked (id, score), with rows told apart only by id and score."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(split(text))
        found = []
        for i, bag in bags:
            n, score = sum(bag.values()), 0
            for t, times in asked.items():
                if t in bag:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:best], 1)]
    return out


def check(spark, docs, items, **limits):
    rows = spark.createDataFrame([(i, t, "q", "r", "s") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in search(rows, asked, **limits).collect()]
    assert Counter(got) == Counter(brute(docs, items, limits.get("best", 10)))


def corpus(n, seed, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 40)))) for i in range(n)], vocabulary


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 300, "splits": 2}, {"block_bytes": 2000, "items_a_task": 3, "blocks_a_task": 1}])
def test_against_all_scores(spark, limits):
    docs, vocabulary = corpus(200, 1)
    r = random.Random(2)
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(12)]
    check(spark, docs, items, **limits)


def test_odd_rows(spark):
    same = [(i, "Equal TEXT here") for i in (900, 3, 17, 5, 4, 8, 700, 600, 500, 400, 300, 200)]
    odd = [(None, "equal text here"), (None, None), (1, ""), (2, " .,;"), (3, "equal"), (3, "equal"), (6, "Émile É émile 日本"), (7, "x" * 50_000)]
    docs = same + odd
    items = [(1, "equal text"), (1, "equal text"), (2, None), (3, ""), (None, "Émile émile"), (5, "nowhere"), (6, "x" * 50_000), (7, "the " * 50 + "text")]
    check(spark, docs, items, block_bytes=100)
    check(spark, docs, items, best=3)


def test_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs, items).collect() == []
    assert search(items.withColumnRenamed("item_id", "doc_id"), items.where("false")).collect() == []


def test_terms():
    for text in ("A-b c_d", "ÀB9 x²y ｚ", "", None, "\x80\xa0 a\x7fb`c{d@e/f:g[h"):
        assert [t.decode() for t in terms(text)] == split(text)


def test_intervals_leave_most_documents_out():
    """Bounds from range maxima settle an item after few of its documents have been scored."""
    random_ = np.random.default_rng(3)
    n = 4000
    lists = {}
    for i in range(30):
        docs = np.flatnonzero(random_.random(n) < 0.3)
        lists[b"t%d" % i] = (docs, random_.zipf(2.0, len(docs)).clip(max=50))
    postings = Postings(lists, random_.integers(50, 3000, n), n, n * 1000)
    item = Item(0)
    item.terms, item.weights = [b"t1", b"t2", b"absent"], [3000, 5000, 9]
    scored = []
    offer = item.offer
    item.offer = lambda scores, docs, ids, best: (scored.extend(docs.tolist()), offer(scores, docs, ids, best))[1]
    postings.search(item, list(range(n)), 10, lexical.SPLITS)
    full = np.zeros(n, np.int64)
    for term, weight in ((b"t1", 3000), (b"t2", 5000)):
        a, b = postings.at[postings.number[term]], postings.at[postings.number[term] + 1]
        full[postings.docs[a:b]] += weight * postings.impact[a:b]
    want = sorted((-int(s), i) for i, s in enumerate(full) if s > 0)[:10]
    assert [(f[0], f[2]) for f in item.found] == want
    assert len(scored) == len(set(scored)) < (full > 0).sum() / 2
