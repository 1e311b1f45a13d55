import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricspark.functions.geo import distance_km, grid_cell
from metricspark.functions.macros import register_python_macro
from metricspark.functions.text import bm25, parse_lines, token_counts
from metricspark.operators.enrich import add_labels, classify, json_schema, schematize

TEXTS = ["the cat and the dog", "a dog", "THE end", "", None, "naïve the"]


def test_add_labels_keeps_facts_without_a_match(spark):
    facts = spark.createDataFrame([(1, 2.0), (9, 3.0), (None, 4.0)], "k int, v double")
    dim = spark.createDataFrame([(1, "one", "x")], "k int, name string, other string")
    got = add_labels(facts, dim, ["k"], ["name"])
    assert got.columns == ["k", "v", "name"]
    assert sorted((r.v, r.name) for r in got.select("v", F.col("name").alias("n")).toDF("v", "name").collect()) == [
        (2.0, "one"),
        (3.0, None),
        (4.0, None),
    ]


def test_first_rule_wins(spark):
    df = spark.createDataFrame([("ab",), ("b",), ("c",), (None,)], "t string")
    rules = [("a", "has-a"), ("b", "has-b")]
    assert [r[0] for r in df.select(classify(F.col("t"), rules)).collect()] == ["has-a", "has-b", "other", "other"]


def test_schematize_joins_types_of_all_rows(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2.5, "b": {"c": "x"}}'), (3, "broken")], "id int, j string")
    assert json_schema(df, "j").startswith("STRUCT<a: D")
    out = schematize(df, "j")
    assert out.columns == ["id", "a", "b"]
    got = [(r.id, None if r.a is None else float(r.a), r.b and r.b.c) for r in out.orderBy("id").collect()]
    assert got == [(1, 1.0, None), (2, 2.5, "x"), (3, None, None)]
    with pytest.raises(ValueError, match="no JSON objects"):
        schematize(spark.createDataFrame([("[1]",)], "j string"), "j")


def test_token_counts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    want = Counter("the cat and the dog a dog the end na ve the".split())
    assert {r.token: r.n for r in token_counts(df, "t").collect()} == want


def test_parse_lines(spark):
    lines = ["2024-01-01 GET 12", "2024-01-01 GET x", "noise", "2024-13-01 PUT 3", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    got = parse_lines(df, "line", r"^(\S+) (\w+) (\w+)$", {"day": "date", "verb": "string", "n": "int"})
    rows = [(r.i, str(r.day), r.verb, r.n, r.parsed) for r in got.orderBy("i").collect()]
    assert rows[0] == (0, "2024-01-01", "GET", 12, True)
    assert [r[1:] for r in rows[1:]] == [("None", None, None, False)] * 4


def test_bm25_by_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t is not None], "i int, t string")
    docs = {i: __import__("re").findall("[a-z]+", t.lower()) for i, t in enumerate(TEXTS) if t is not None}
    mean = sum(map(len, docs.values())) / len(docs)
    terms = ["the", "dog", "missing"]
    want = {}
    for i, words in docs.items():
        score = 0.0
        for t in terms:
            tf, df_t = words.count(t), sum(t in d for d in docs.values())
            idf = math.log(1 + (len(docs) - df_t + 0.5) / (df_t + 0.5))
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if any(t in words for t in terms):
            want[i] = (sum(words.count(t) for t in terms), pytest.approx(score))
    assert {r.i: (r.matches, r.score) for r in bm25(df, "i", "t", terms).collect()} == want


def test_places(spark):
    df = spark.createDataFrame([(48.8566, 2.3522), (-0.1, -0.1), (90.0, 0.0)], "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    rows = df.select(grid_cell(lat, lon, 1.0), distance_km(lat, lon, 51.5074, -0.1278)).collect()
    assert [r[0] for r in rows] == ["48:2", "-1:-1", "90:0"]
    assert rows[0][1] == pytest.approx(343.6, abs=0.5)


def test_python_macro(spark):
    def halve(x: pd.Series) -> pd.Series:
        return x / 2

    register_python_macro(spark, "halve", halve, "double")
    assert spark.sql("select halve(cast(3 as double))").first()[0] == 1.5
