"""An index read for some terms: the plan, the scores, the best texts, odd texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from metricspark.operators.text_index import TextIndex


def texts(n, seed=1):
    r = random.Random(seed)
    words = [chr(97 + i) * 3 for i in range(12)]
    return [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(12)], k=r.randint(0, 30)))) for i in range(n)]


def brute(rows, terms):
    bags = [(k, re.findall("[a-z]+", (t or "").lower())) for k, t in rows]
    n, mean = len(bags), sum(len(b) for _, b in bags) / max(len(bags), 1)
    df = Counter(w for _, b in bags for w in set(b))
    out = {}
    for k, b in bags:
        tf = Counter(b)
        if matches := sum(tf[t] for t in terms):
            idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
            score = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in terms)
            out[k] = (matches, round(score, 9))
    return out


def index_of(spark, rows, path, **limits):
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    TextIndex.write(df, "id", "t", path, **limits)
    return TextIndex.read(spark, path)


@pytest.mark.parametrize("terms", [["aaa"], ["aaa", "lll", "nowhere"], ["kkk", "kkk", "jjj"], ["nowhere"], []])
def test_scores_and_best(spark, tmp_path, terms):
    rows = [*texts(300), (900, None), (901, ""), (902, "AAA? aaa! KKK")]
    index = index_of(spark, rows, str(tmp_path / "index"), block_texts=20, parts=5)
    want = brute(rows, terms)
    assert {r.key: (r.matches, round(r.score, 9)) for r in index.search(terms).collect()} == want
    best = sorted(((-s, k) for k, (_, s) in want.items()))[:7]
    assert [(-round(r.score, 9), r.key) for r in index.search(terms, 7).collect()] == best


def test_a_query_reads_the_postings_of_its_terms(spark, tmp_path):
    index = index_of(spark, texts(300), str(tmp_path / "index"), block_texts=20, parts=7)
    text = index.postings(["bbb"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = \d", text) and "EqualTo(term,bbb)" in text
    files = {r[0] for r in index.postings(["bbb"]).select(F.input_file_name()).collect()}
    assert len({f.split("part=")[1][0] for f in files}) == 1


def test_few_blocks_are_scored_for_the_best(spark, tmp_path):
    rows = [(i, "common " * 3 + "filler " * (i % 50)) for i in range(2000)] + [(5000 + i, "rare common") for i in range(5)]
    index = index_of(spark, rows, str(tmp_path / "index"), block_texts=50)
    found = index.search(["rare", "common"], 5)
    assert sorted(r.key for r in found.collect()) == [5000, 5001, 5002, 5003, 5004]


def test_an_index_of_nothing(spark, tmp_path):
    index = index_of(spark, [], str(tmp_path / "index"))
    assert index.search(["a"]).collect() == [] and index.search(["a"], 3).collect() == []


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(
        DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **b))[1]
    )
    index_of(spark, texts(50), str(tmp_path / "index"), block_texts=20, parts=5)
    assert [len(re.findall("(?:range|hash)partitioning", p)) for p in plans if "postings" in p] == [1]


def test_rows_of_one_key_are_one_text_of_their_common_length(spark, tmp_path):
    rows = [(1, "a b a"), (1, "b b a"), (1, "a"), (2, "c"), (None, "a c"), (None, "c a"), (None, "b")]
    index = index_of(spark, rows, str(tmp_path / "index"), block_texts=2)
    held = index.postings(["a", "b", "c"]).select("term", F.inline("postings")).collect()
    assert Counter((r.term, r.key, r.tf) for r in held) == Counter(
        [("a", 1, 3), ("b", 1, 3), ("a", 1, 1), ("c", 2, 1), ("a", None, 2), ("c", None, 2), ("b", None, 1)]
    )
