import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from metricspark.operators import quantiles
from metricspark.operators.quantiles import exact_quantiles

QS = (0.0, 0.001, 0.07, 0.5, 0.9, 0.999, 1.0)


def brute(values, q):
    ordered = sorted(values, key=lambda x: (math.isnan(x), x))
    rank = max(1, math.ceil(Fraction(str(q)) * len(ordered)))
    return ordered[rank - 1]


def check(spark, rows, **limits):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", QS, **limits).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for i, q in enumerate(QS):
            want = brute(vs, q)
            have = got[k][f"q_{i}"]
            assert have == want or (math.isnan(have) and math.isnan(want)), (k, q, have, want)


# brackets from an exact sketch and from coarse ones, and narrowing passes within brackets
PATHS = [{}, {"accuracy": 20}, {"accuracy": 20, "rank_rows": 3}, {"accuracy": 500, "rank_rows": 40}]


@pytest.mark.parametrize("limits", PATHS)
def test_one_series_holds_most_rows(spark, limits):
    rnd = random.Random(3)
    rows = [("hot", rnd.lognormvariate(0, 4)) for _ in range(3000)]
    rows += [("hot", 42.0)] * 500 + [(None, float(i)) for i in range(100)] + [("one", -1.5)]
    rows += [(f"k{i % 50}", rnd.uniform(-1, 1)) for i in range(500)]
    check(spark, rows, **limits)


@pytest.mark.parametrize("limits", PATHS)
@pytest.mark.parametrize(
    "values",
    [
        [0.0, -0.0, 1e-308, -1e-308, 5e-324],
        [math.inf, -math.inf, 1.0, 2.0, 1.7e308, -1.7e308],
        [math.nan, 1.0, 2.0, math.nan, math.inf],
        [math.nan, math.nan],
        [1.0 + i * 2.0**-52 for i in range(20)],
        [1.7e9 + i / 1000 for i in range(200)],
        [10.0**i for i in range(-300, 300, 7)],
        [7.0] * 30,
    ],
)
def test_difficult_values(spark, limits, values):
    check(spark, [("a", v) for v in values], **limits)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(allow_nan=False)), min_size=1, max_size=40))
def test_any_values(spark, rows):
    check(spark, rows, accuracy=5, rank_rows=2)


def test_no_keys_and_two_keys(spark):
    df = spark.range(1000).selectExpr("id % 2 as a", "id % 3 as b", "cast(id as double) as v")
    for limits in PATHS:
        r = exact_quantiles(df, [], "v", (0.5,), **limits).collect()
        assert [(x.n, x.total, x.q_0) for x in r] == [(1000, 499500.0, 499.0)]
        by_two = exact_quantiles(df, ["a", "b"], "v", (1.0,), **limits).collect()
        assert sorted(x.q_0 for x in by_two) == [994.0, 995.0, 996.0, 997.0, 998.0, 999.0]


@pytest.mark.parametrize("values", [[math.nan, 1.0, -math.inf, 3.0, 3.0, 1e300, 2.0], [float(i % 97) for i in range(400)]])
def test_one_series_without_keys(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = exact_quantiles(df, [], "v", QS, accuracy=5, rank_rows=2).first()
    for i, q in enumerate(QS):
        want = brute(values, q)
        assert r[f"q_{i}"] == want or (math.isnan(want) and math.isnan(r[f"q_{i}"]))


def test_narrowing_never_joins_without_a_key(spark):
    df = spark.range(500).selectExpr("cast(id as double) as v", "id % 2 as k")
    for keys in ([], ["k"]):
        text = exact_quantiles(df, keys, "v", (0.5,), accuracy=5, rank_rows=2)._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_many_ranges_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", 0)
    rnd = random.Random(5)
    check(spark, [(f"k{i % 7}", rnd.gauss(0, 100)) for i in range(700)], accuracy=10, rank_rows=5)


@pytest.mark.parametrize("limits", PATHS[1:])
def test_a_large_series_is_dealt_over_salts(spark, monkeypatch, limits):
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", 0)
    monkeypatch.setattr(quantiles, "SALTED_SHARES", 16)
    rnd = random.Random(6)
    rows = [("hot", rnd.gauss(0, 100)) for _ in range(1000)] + [("hot", 7.0)] * 400
    check(spark, rows + [(None if i % 90 == 0 else f"k{i % 90}", rnd.random()) for i in range(1800)], **limits)


def test_raw_rows_are_never_shuffled_by_the_series_alone(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3000).selectExpr("if(id % 3 = 0, -1, id % 50) as k", "cast(id as double) as v").write.parquet(path)
    rows = spark.read.parquet(path)
    series = rows.groupBy("k").count().selectExpr("k", "count as series_n", "0D as lo", "9999D as hi")
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", 0)
    monkeypatch.setattr(quantiles, "SALTED_SHARES", 30)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt, copies, names = quantiles._sides(rows, series, ["k"], "v")
        found = quantiles._match(dealt, copies, names)
        assert found.count() == 3000
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert names == ["k", "salt"] and "SortMergeJoin" in text
    assert dealt.where("k = -1").select("salt").distinct().count() == 10
    assert dealt.groupBy(*names).count().agg({"count": "max"}).first()[0] < 200


def test_rank_is_exact_in_decimals(spark):
    df = spark.range(1, 101).selectExpr("'a' as k", "cast(id as double) as v")
    for limits in PATHS:
        r = exact_quantiles(df, ["k"], "v", (0.07, 0.29, 0.57), **limits).first()
        assert (r.q_0, r.q_1, r.q_2) == (7.0, 29.0, 57.0)
