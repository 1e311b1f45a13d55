import pytest
from pyspark.sql import functions as F

from metricspark.operators.labels import canonical_map, full_name, label_names, merge
from metricspark.operators.samples import extract, is_value_column, split_columns


def got(spark, sql):
    return [(r.labels, r.value) for r in extract(spark.sql(sql)).collect()]


@pytest.mark.parametrize(
    "name, is_value",
    [("value", True), ("val", True), ("v", True), ("count(1)", True), ("Value", False), ("values", False), ("a(", False)],
)
def test_value_column_names(name, is_value):
    assert is_value_column(name) is is_value


def test_split_columns():
    assert split_columns(["a", "value", "b", "sum(x)"]) == ({"a": 0, "b": 2}, 3)
    assert split_columns(["a", "ord"], "ord") == ({"a": 0}, None)


def test_last_value_column_wins_and_none_is_zero(spark):
    assert got(spark, "select 'x' as a, 1 as value, 2 as v") == [({"a": "x"}, 2.0)]
    assert got(spark, "select 'x' as a") == [({"a": "x"}, 0.0)]
    assert got(spark, "select 7 as val") == [({}, 7.0)]


def test_unaliased_functions_are_values(spark):
    sql = "select g, count(*), max(x) from values ('a', 1), ('a', 5) t(g, x) group by g"
    assert got(spark, sql) == [({"g": "a"}, 5.0)]


@pytest.mark.parametrize(
    "expr, value",
    [
        ("cast(null as int)", 0.0),
        ("'12.5'", 12.5),
        ("'twelve'", 0.0),
        ("true", 1.0),
        ("false", 0.0),
        ("timestamp '2024-01-01 00:00:00'", 0.0),
        ("date '2024-01-01'", 0.0),
        ("array(1)", 0.0),
        ("cast(3.25 as decimal(10,2))", 3.25),
        ("cast(9007199254740993 as decimal(38,0))", 9007199254740992.0),
    ],
)
def test_value_coercion(spark, expr, value):
    assert got(spark, f"select {expr} as value") == [({}, value)]


@pytest.mark.parametrize(
    "expr, text",
    [
        ("cast(null as string)", "NULL"),
        ("cast(null as int)", "NULL"),
        ("7", "7"),
        ("true", "true"),
        ("6.0D", "6"),
        ("0.1D", "0.1"),
        ("cast(0.1 as float)", "0.1"),
        ("1e7", "1e+07"),
        ("timestamp_ntz '2024-01-01 00:00:07.17'", "2024-01-01 00:00:07.17 +0000 UTC"),
        ("timestamp '2024-01-01 00:00:07'", "2024-01-01 00:00:07 +0000 UTC"),
        ("date '2024-01-02'", "2024-01-02 00:00:00 +0000 UTC"),
        ("array(1, null, 3)", "[1 <nil> 3]"),
        ("named_struct('b', 1, 'a', 'x')", "map[a:x b:1]"),
        ("map('k', 1.5D)", "map[k:1.5]"),
    ],
)
def test_label_text(spark, expr, text):
    assert got(spark, f"select {expr} as a, 1 as v") == [({"a": text}, 1.0)]


def test_time_labels_are_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        sql = "select timestamp '2024-01-01 00:00:00' as a, 1 as v"
        assert got(spark, sql) == [({"a": "2024-01-01 05:00:00 +0000 UTC"}, 1.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_repeated_column_name_keeps_the_last(spark):
    assert got(spark, "select 'x' as a, 'y' as a, 1 as v") == [({"a": "y"}, 1.0)]


def test_bad_label_name(spark):
    with pytest.raises(ValueError, match="my col"):
        extract(spark.sql("select 1 as `my col`, 1 as v"))


def test_names():
    assert full_name("prefix_", "test-package", "metric_name") == "prefix_test_package_metric_name"
    assert full_name("", "test", "metric_name") == "test_metric_name"
    assert label_names(["a", "b"], {"b": "1", "c": "2"}) == ["a", "b", "c"]


def test_merge_lets_the_right_side_win(spark):
    df = spark.sql("select map('a', '1', 'b', '2') as l, map('b', '3', 'c', '4') as r")
    assert df.select(merge(F.col("l"), F.col("r"))).first()[0] == {"a": "1", "b": "3", "c": "4"}


def test_canonical_labels_are_sorted_and_escaped(spark):
    df = spark.createDataFrame([({"b": 'x"y', "a": "l1\nl2", "c": "d\\e"},)], "l map<string,string>")
    assert df.select(canonical_map(F.col("l"))).first()[0] == 'a="l1\\nl2",b="x\\"y",c="d\\\\e"'
