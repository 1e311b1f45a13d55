"""Many rules against a walk through all of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from metricspark.operators.rules import classify_many, needed_literal


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        (r"^https?://m\.", "://m."), (r"[?&]page=\d+", "page="), (r"\.org(/|$)", ".org"), (r"/(fr|de)/", "/"), ("abc|def", ""),
        ("(?i)abc", ""), ("abcd*", "abc"), ("abc+de", "abc"), ("ab{2,3}cde", "cde"), ("a.bcd[xyz]ef", "bcd"), (r"\babc\d", "abc"),
        ("(abc)def", "def"), ("(?:abc)?de", "de"), ("[]a]bcd", "bcd"), (r"[a\]b]cde", "cde"), ("", ""), ("x?yz", "yz"), (r"\Qa.b\E", ""),
    ],
)
def test_needed_literals(pattern, literal):
    assert needed_literal(pattern) == literal


def test_the_first_of_ten_thousand_rules(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(4000)]
    rules = [(rf"{w}\d*x?" if i % 3 else f"(^| ){w}", f"c{i % 50}") for i, w in enumerate(r.choices(words, k=9990))]
    rules[3000:3000] = [(r"\d\d\d", "three digits"), ("zz|yy", "alternatives"), (r"^.$", "one")]
    texts = [" ".join(r.choices(words, k=r.randint(0, 3)) + [str(r.randint(0, 200))]) for _ in range(300)]
    texts += [None, "", "a", "zz", "ab", "é日本語", *texts[:5]]
    rows = [(None if i % 40 == 0 else i % 250, t, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, t string, class string").repartition(3)
    got = sorted((str(x.id), str(x.t), x["class"]) for x in classify_many(df, "id", "t", rules).collect())
    compiled = [(re.compile(p), c) for p, c in rules]
    first = {t: next((c for p, c in compiled if t is not None and p.search(t)), "other") for t in texts}
    assert got == sorted((str(i), str(t), first[t]) for i, t, _ in rows)


def test_patterns_run_on_candidates_only(spark):
    rules = [(f"needle{i}[0-9]", "n") for i in range(50)]
    df = spark.range(100).selectExpr("id", "concat('hay ', id) as t")
    out = classify_many(df, "id", "t", rules)
    assert out.where(F.col("class") != "other").isEmpty()
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_rules_and_no_texts(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert [r["class"] for r in classify_many(df, "id", "t", []).collect()] == ["other"]
    assert classify_many(df.where("false"), "id", "t", [("abc", "x")]).collect() == []
