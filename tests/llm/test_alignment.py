"""Cross-tokenizer alignment against a walk over both tokenizers' tokens, one text at a time."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from metricspark.llm.alignment import align, byte_level, pieces

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a string, block string"


def tokens_of(rows):
    """Per row the ids and end bytes of both sides, empty where the bytes differ."""
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(BYTES, "rb") as f, open(PIECES, "rb") as g:
        tables = byte_level(f.read())[1].tokens, pieces(g.read())[1].tokens
    for _, text in rows:
        sides = [whole.encode(" " + text, add_special_tokens=False).ids, model.encode(text)] if text else [[], []]
        if any(b"".join(t[i] for i in ids) != (" " + (text or "")).encode() for ids, t in zip(sides, tables)):
            sides = [[], []]
        ends = []
        for ids, t in zip(sides, tables):
            at, out = 0, []
            for i in ids:
                at += len(t[i])
                out.append(at)
            ends.append(out)
        yield sides, ends


def walked(rows):
    found, documents = [], Counter()
    for (a, b), (a_ends, b_ends) in tokens_of(rows):
        links, groups, i, j, first = [], [], 0, 0, (0, 0)
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = a_ends[i], b_ends[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                sides = (a[first[0] : i], b[first[1] : j])
                groups.append("|".join(",".join(map(str, s)) for s in sides))
                first = (i, j)
        documents.update(set(links))
        found.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    for (_, _, groups, links), (identity, _), (n_a, n_b, _, _) in zip(found, rows, found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        best = sum(documents[x] == most[x[0]] for x in links)
        yield (identity, n_a, n_b, len(groups), len(links), best, sum(documents[x] for x in links), digest), documents, most


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, rows, **limits):
    docs = spark.createDataFrame([(i, t, "n", "b") for i, t in rows], DOCS).repartition(3)
    done = align(docs, BYTES, PIECES, **limits)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in done.documents.collect())
    want = list(walked(rows))
    assert got == Counter(w for w, _, _ in want)
    documents, most = want[-1][1:]
    pairs = {(r.a, r.b): (r.n, r.best) for r in done.pairs.collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in documents.items()}


def test_texts_of_the_table_over_many_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()], block_bytes=20_000)


def test_odd_texts(spark):
    texts = [
        None, "", " ", "\n\n", "  two  blanks ", "a▁b", "▁", "日本語 のテキスト", "naïve café", "😀 👩‍👩‍👧 ok", "\x00\x01 ab",
        "<s> <|endoftext|> </s> <0x41> <unk>", "x" * 20_000, "word " * 3000, "tab\tand\r\nline", "1234567890 12.5%", "½ ﬁ Ⅷ",
        "it's we'll I'd", "word word word", "אבג עברית", "ﷺ", "á é", "﻿mark", "soft­hyphen",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    check(spark, rows + [(None, "same text"), (None, "same text"), (7, "same text"), (7, None)], block_bytes=500)


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    done = align(empty, BYTES, PIECES)
    assert done.documents.collect() == [] and done.pairs.collect() == []
    assert done.documents.columns == list(COLUMNS)


def test_the_encoder_equals_the_tokenizers_library_on_every_kind_of_code_point():
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    with open(BYTES, "rb") as f:
        encoder = byte_level(f.read())[0]
    points = [c for c in [*range(0, 0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}.  {chr(c)}\n{chr(c)}" for c in points]
    ids = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode_ordinary(t) for t in texts] == ids
