"""Null, repeated and shared ids, texts without words, and empty tables, each against a brute-force rule."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from metricspark.llm.jaccard import jaccard_join
from metricspark.llm.lines import dedup_lines
from metricspark.llm.queries import ORACLES, QUERIES

SYMBOLS = [chr(c) * n for c in range(0x2600, 0x2632) for n in (1, 2)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG.replace("word30", "other")


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)


ROWS = [
    *enumerate(SYMBOLS),
    (200, SYMBOLS[0]), (200, SYMBOLS[0]), (201, "!!! ???"), (202, "!!!  ???"), (203, None), (204, ""), (205, " "),
    (None, LONG), (None, NEAR), (None, "alone without an id"), (None, None), (300, NEAR), (300, "shares an id with a copy"),
    (300, "another with that id"), (None, LONG),
]


def groups():
    """Places in ROWS that belong together."""
    by_text = defaultdict(list)
    for at, (_, text) in enumerate(ROWS):
        by_text["long" if text in (LONG, NEAR) else text or ""].append(at)
    return list(by_text.values())


def test_links_of_texts_without_words_and_of_rows_without_ids(spark):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(rows_of(spark, ROWS)).collect())
    want = Counter()
    for places in groups():
        ids = [ROWS[at][0] for at in places]
        least = min((i for i in ids if i is not None), default=None)
        want.update((i, least, len(places) - 1) for i in ids)
    assert got == want


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, rows_of(spark, ROWS), "").collect())
    want = Counter()
    for places in groups():
        least = min(((ROWS[at][0] is None, ROWS[at][0] or 0) for at in places))
        want[[ROWS[at] for at in places if (ROWS[at][0] is None, ROWS[at][0] or 0) == least][0]] += 1
    texts = lambda counts: Counter((i, "" if not t else t) for (i, t), n in counts.items() for _ in range(n))
    assert texts(kept) == texts(want)


def test_lines_of_repeated_and_null_ids(spark, tmp_path):
    line = "a line of more than twenty characters"
    other = "another line that has enough characters"
    rows = [(1, line), (1, line), (2, line), (3, other), (4, other), (5, other), (5, other), (None, other), (None, line), (6, None)]
    docs = rows_of(spark, rows)
    got = Counter((r.doc_id, r.text, r.n_dropped) for r in dedup_lines(docs, batches=2, fan=2).collect())
    want = [(1, line, 0), (1, line, 0), (2, line, 0), (3, "", 1), (4, "", 1), (5, other, 0), (5, other, 0), (None, "", 1), (None, line, 0), (6, "", 0)]
    assert got == Counter(want)
    # the query's twin says the same, id by id; rows of one id are one document there
    once = [(1, line), (2, line), (3, other), (4, other), (5, other), (6, None), (None, other)]
    rows_of(spark, once).write.parquet(str(tmp_path / "documents.parquet"))
    query = QUERIES["op4_line_dedup"](spark, str(tmp_path))
    columns = sorted(query.columns)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    twin = con.execute(f"select {', '.join(columns)} from ({ORACLES['op4_line_dedup']})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in query.collect()) == Counter(twin)


def test_line_runs_are_removed(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert dedup_lines(rows_of(spark, [(i, LONG) for i in range(40)]), batches=4, fan=2).count() == 40
    assert {t.name for t in spark.catalog.listTables()} == before


def test_empty_tables(spark):
    none = rows_of(spark, ROWS).where(F.lit(False))
    assert dedup_lines(none).collect() == [] and jaccard_join(none).collect() == []


def test_frequent_words_are_few_and_the_most_frequent(spark):
    from metricspark.llm.bpe import frequent_words

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(2 + 2000 // (i + 1)))
    docs = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    some = {w.decode().strip() for w in frequent_words(docs, "text", 20)}
    assert {"waa", "wba", "wca"} <= some and 10 <= len(some) <= 25
    same = spark.createDataFrame([(" ".join(words * 3),)], "text string")
    assert 20 <= len(frequent_words(same, "text", 60)) <= 110
    assert len(frequent_words(same, "text", 1000)) >= 200 and frequent_words(docs.where("false"), "text") == []
