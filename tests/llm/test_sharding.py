"""Hilbert sharding: the curve, the laws, the files that a scan reads."""

from __future__ import annotations

import datetime
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricspark.llm.queries import QUERIES
from metricspark.llm.sharding import hilbert_index, lay_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string"


def docs_of(spark, n):
    row = F.expr("named_struct('lang', element_at(array('de', 'en', null), int(id % 3 + 1)), 'source', concat('https://s', id % 11))")
    text = F.expr("case when id % 13 = 0 then null else repeat('é', int(id * 37 % 101)) end")
    rows = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), row.alias("r"))
    return rows.select(
        "doc_id", "text", "r.lang", "r.source", F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("shard"), F.lit("y").alias("slot")
    )


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 1), (2, 4), (3, 2), (4, 2), (5, 1)])
def test_the_curve_visits_every_point_once_by_single_steps(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    place = hilbert_index(grid, bits)
    assert sorted(place.tolist()) == list(range(1 << (bits * dimensions)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 15, 500])
@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(spark, n, law):
    docs = docs_of(spark, n)
    layout = lay_out(docs.repartition(3), least_pieces=7)
    found = layout.shards(16, law)
    rows = found.collect()
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "curve", "shard", "slot"]
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    in_shard, size = Counter(r.shard for r in rows), Counter()
    for r in rows:
        size[r.shard] += len((r.text or "").encode()) + 1
    for shard, count in in_shard.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(count))
    if law == "rows":
        assert {in_shard[k] for k in range(16)} <= {n // 16, -(-n // 16)}
    elif n >= 500:
        assert max(size.values()) - min(size.values()) <= 2 * 203
    # shards are runs of the curve, and are read back alone
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    if n:
        alone = layout.shard(15, 16, law).collect()
        assert sorted(r.doc_id for r in alone) == sorted(r.doc_id for r in rows if r.shard == 15)


def test_a_scan_reads_the_files_that_its_ranges_meet(spark):
    layout = lay_out(docs_of(spark, 2000), least_pieces=40)
    for ranges, sql in (
        ({"lang": ("de", "de"), "n_chars": (0, 20)}, "lang = 'de' and n_chars <= 20"),
        ({"source": ("https://s10", "https://s10")}, "source = 'https://s10'"),
        ({"n_chars": (101, 200)}, "false"),
    ):
        some = layout.scan(ranges)
        want = sorted(r.doc_id for r in docs_of(spark, 2000).where(sql).collect())
        assert sorted(r.doc_id for r in some.collect()) == want
        assert len(some.inputFiles()) <= len(layout.written.inputFiles()) * (0.6 if want else 1)


def test_copies_of_one_row_fill_many_files(spark):
    one = spark.createDataFrame([(1, "same", "en", "s", 4, "", "")], DOCS)
    docs = one.join(spark.range(900).select(), how="cross").repartition(6).unionByName(docs_of(spark, 100))
    layout = lay_out(docs, least_pieces=8)
    assert layout.manifest.agg(F.max("n")).first()[0] <= 400
    assert Counter(r.shard for r in layout.shards(4).collect()) == {0: 250, 1: 250, 2: 250, 3: 250}


def test_equal_texts_of_one_place_lie_together(spark):
    rows = [(i, f"text {i % 5}", "en", "s", 6, "", "") for i in range(50)]
    found = lay_out(spark.createDataFrame(rows, DOCS)).shards(1).collect()
    texts = [r.text for r in sorted(found, key=lambda r: r.slot)]
    assert sum(a != b for a, b in zip(texts, texts[1:])) == 4


def test_dimensions_of_other_types(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(i), float("nan") if i == 3 else -1.5 * i, i % 2 == 0, "t") for i in range(40)] + [(40, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, day date, x double, even boolean, text string")
    frame = frame.withColumn("at", F.col("day").cast("timestamp"))
    found = lay_out(frame, ("day", "x", "even", "at")).shards(4).collect()
    assert sorted(r.doc_id for r in found) == list(range(41))


def test_query_columns(spark):
    rows = QUERIES["op11_hilbert_sharding"](spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"
    }
