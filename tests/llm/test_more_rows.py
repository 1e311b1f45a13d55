"""Empty tables, repeated rows, null ids and clashing columns of the operators that other files do not ask for them."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from metricspark.llm import bpe, chat, quality, warc
from metricspark.llm.decontamination import with_leaks
from metricspark.llm.embeddings import range_join
from metricspark.llm.surrogates import replace_pii

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(2)


def test_chats_of_nothing(spark):
    chats = chat.Chats(spark, VOCABULARY)
    none = frame(spark, [], "conv_id long, turn long, role string, text string")
    assert chats.read(chats.format(none)).collect() == []


def test_leaks_of_nothing_of_repeated_rows_and_beside_a_column_of_that_name(spark):
    item = "the quick brown fox jumps over the lazy dog and runs home again tonight"
    items = frame(spark, [(1, item), (None, None), (2, "")], "item_id long, text string")
    docs = frame(spark, [(1, f"so {item} it went", "x"), (1, f"so {item} it went", "x"), (2, "clean", "x"), (None, None, "x")], "doc_id long, text string, leaks string")
    found = with_leaks(docs, items).collect()
    assert Counter((r.doc_id, tuple(x["item"] for x in r.leaks)) for r in found) == Counter({(1, (1,)): 2, (2, ()): 1, (None, ()): 1})
    assert with_leaks(docs.where("false"), items).collect() == []
    assert all(not r.leaks for r in with_leaks(docs, items.where("false")).collect())


def test_leaks_in_a_text_of_over_a_million_characters(spark):
    item = "zebra violin copper lantern meadow thunder pickle harbor velvet compass"
    docs = frame(spark, [(1, "plain words here " * 70_000 + item + " and more" * 10_000)], "doc_id long, text string")
    assert [x["item"] for x in with_leaks(docs, frame(spark, [(7, item)], "item_id long, text string")).first().leaks] == [7]


def test_surrogates_of_nothing_of_repeated_rows_and_beside_columns_of_those_names(spark):
    text = "Write to mary.jones@corp.example.com or call Mary Jones."
    docs = frame(spark, [(1, text, "x"), (1, text, "x"), (None, None, "x")], "doc_id long, text string, n_entities string")
    rows = replace_pii(docs).collect()
    texts = {r.text for r in rows if r.doc_id == 1}
    assert len(rows) == 3 and len(texts) == 1 and "mary.jones@corp" not in texts.pop()
    assert replace_pii(docs.where("false")).collect() == []


def test_scores_of_nothing_of_repeated_rows_and_beside_columns_of_those_names(spark):
    docs = frame(spark, [(1, "good words", "x", "y"), (1, "good words", "x", "y"), (None, None, "x", "y")], "doc_id long, text string, score string, predicted string")
    labels = frame(spark, [(1, 1), (None, 0), (1, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.classify(docs, model).collect()
    assert len(rows) == 3 and len({round(r.score, 5) for r in rows if r.doc_id == 1}) == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.classify(docs.where("false"), model).collect() == []


def test_encoding_of_nothing(spark):
    docs = frame(spark, [(1, "some words")], "doc_id long, text string").where("false")
    tokenizer = bpe.with_lexicon(docs, "text", VOCABULARY)
    assert docs.withColumn("ids", tokenizer.encode(F.col("text"))).collect() == []


def test_vectors_with_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0], [0.99, 0.05], [0.0, 1.0]
    rows = [(None, a), (5, a), (5, b), (7, b), (8, c), (8, c), (None, c), (9, None)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in range_join(frame(spark, rows, "vec_id long, embedding array<double>")).collect())
    want = [(None, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (8, 2, 8, True), (8, 2, 8, True), (None, 2, 8, False), (9, 0, 9, True)]
    assert got == Counter(want)


def test_archives_of_null_and_repeated_ids(spark):
    big = "x" * 200
    rows = [(None, "http://a.org/1", big), (3, "http://a.org/2", big), (3, "http://a.org/3", big), (4, "http://a.org/4", big), (5, None, None)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    archive = warc.write(pages)
    found = archive.fetch(archive.look_up(pages)).collect()
    got = Counter((r.page, r.record_type, r.refers_to) for r in found)
    assert got == Counter([(None, "revisit", 3), (3, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None)])
