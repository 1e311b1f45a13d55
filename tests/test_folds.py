import math

import pytest

from metricspark.defs import MetricDef
from metricspark.operators.folds import flat, fold_rows, summary_exact
from metricspark.operators.samples import to_rows


def fold(spark, sql, *metrics, labels=None, order_by=None):
    rows = to_rows(spark.sql(sql), order_by, labels)
    out = fold_rows(rows, [(m, m.name) for m in metrics], labels)
    return {(r.name + r.suffix, r.labels): r.value for r in flat(out).collect()}


ROWS = "values ('a', 1.0D, 1), ('a', 3.0D, 2), ('a', 2.0D, 3), ('b', 5.0D, 1), (null, 7.0D, 1) t(g, x, o)"


def test_gauge_keeps_the_greatest_value(spark):
    got = fold(spark, f"select g, x as v from {ROWS}", MetricDef("gauge", "m", ""))
    assert got == {("m", 'g="a"'): 3.0, ("m", 'g="b"'): 5.0, ("m", 'g="NULL"'): 7.0}


def test_gauge_keeps_the_last_row_by_its_order(spark):
    got = fold(spark, f"select g, x as v, o from {ROWS}", MetricDef("gauge", "m", "", order_by="o"), order_by="o")
    assert got[("m", 'g="a"')] == 2.0


def test_null_and_the_text_null_are_one_series(spark):
    got = fold(spark, "select g, 1 as v from values ('NULL'), (null) t(g)", MetricDef("counter", "m", ""))
    assert got == {("m", 'g="NULL"'): 2.0}


def test_counter_counts_rows(spark):
    got = fold(spark, f"select g, x as v from {ROWS}", MetricDef("counter", "m", ""))
    assert got[("m", 'g="a"')] == 3.0


def test_histogram_bounds_are_inclusive(spark):
    got = fold(spark, f"select x as v from {ROWS}", MetricDef("histogram", "m", "", buckets=(2.0, 3.0, 6.0)))
    assert got == {
        ("m_bucket", 'le="2"'): 2.0,
        ("m_bucket", 'le="3"'): 3.0,
        ("m_bucket", 'le="6"'): 4.0,
        ("m_bucket", 'le="+Inf"'): 5.0,
        ("m_sum", ""): 18.0,
        ("m_count", ""): 5.0,
    }


def test_histogram_default_and_infinite_bounds(spark):
    got = fold(spark, "select 0.3D as v", MetricDef("histogram", "m", ""))
    assert [k[1] for k in got if k[0] == "m_bucket"] == [
        f'le="{b}"' for b in ("0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10", "+Inf")
    ]
    assert sum(got[("m_bucket", f'le="{b}"')] for b in ("0.25", "0.5")) == 1.0
    infinite = fold(spark, "select 0.3D as v", MetricDef("histogram", "m", "", buckets=(1.0, math.inf)))
    assert [k[1] for k in infinite if k[0] == "m_bucket"] == ['le="1"', 'le="+Inf"']


def test_not_a_number_counts_above_every_bound(spark):
    got = fold(spark, "select double('NaN') as v", MetricDef("histogram", "m", "", buckets=(1.0,)))
    assert got[("m_bucket", 'le="1"')] == 0.0 and got[("m_bucket", 'le="+Inf"')] == 1.0


def test_summary_merges_equal_objectives(spark):
    m = MetricDef("summary", "m", "", objectives=(0.5, 0.9, 0.5))
    for out in (
        fold_rows(to_rows(spark.sql(f"select x as v from {ROWS}")), [(m, "m")]),
        summary_exact(to_rows(spark.sql(f"select x as v from {ROWS}")), m, "m"),
    ):
        got = [(r.suffix, r.labels, r.value) for r in out.orderBy("pos").transform(flat).collect()]
        assert got == [
            ("", 'quantile="0.5"', 3.0),
            ("", 'quantile="0.9"', 7.0),
            ("_sum", "", 18.0),
            ("_count", "", 5.0),
        ]


def test_summary_without_objectives(spark):
    m = MetricDef("summary", "m", "")
    for out in (
        fold_rows(to_rows(spark.sql(f"select x as v from {ROWS}")), [(m, "m")]),
        summary_exact(to_rows(spark.sql(f"select x as v from {ROWS}")), m, "m"),
        summary_exact(to_rows(spark.sql(f"select x as v from {ROWS}")), m, "m", rank_rows=1, accuracy=2),
    ):
        assert {(r.suffix, r.value) for r in out.collect()} == {("_sum", 18.0), ("_count", 5.0)}


@pytest.mark.parametrize("kind", ["gauge", "counter", "histogram", "summary"])
@pytest.mark.parametrize("columns", ["x as v", "g, x as v"])
def test_empty_result_gives_no_series(spark, kind, columns):
    sql = f"select {columns} from {ROWS} where x > 100"
    assert fold(spark, sql, MetricDef(kind, "m", "", objectives=(0.5,))) == {}
    if kind == "summary":
        m = MetricDef(kind, "m", "", objectives=(0.5,))
        assert summary_exact(to_rows(spark.sql(sql)), m, "m").collect() == []


def test_global_labels_replace_query_labels(spark):
    got = fold(spark, f"select g, o, x as v from {ROWS}", MetricDef("counter", "m", ""), labels={"o": "all", "env": "t"})
    assert got[("m", 'env="t",g="a",o="all"')] == 3.0


def test_label_values_are_escaped_and_help_may_hold_quotes(spark):
    m = MetricDef("gauge", "m", "", help="it's a \\ \"test\"")
    rows = to_rows(spark.createDataFrame([('a"b\\c\nd', 1.0)], "g string, v double"))
    r = fold_rows(rows, [(m, "m")]).first()
    assert r.series == 'g="a\\"b\\\\c\\nd"'
    assert r.help == m.help
    assert r.labels == {"g": 'a"b\\c\nd'}


def test_map_holds_extra_label(spark):
    m = MetricDef("histogram", "m", "", buckets=(1.0,))
    r = fold_rows(to_rows(spark.sql("select 'x' as g, 1 as v")), [(m, "m")]).orderBy("pos").first()
    assert r.labels == {"g": "x", "le": "1"} and r.series == 'g="x",le="1"' and r.base == 'g="x"'


@pytest.mark.parametrize("kind, label", [("histogram", "le"), ("summary", "quantile")])
def test_reserved_labels(spark, kind, label):
    with pytest.raises(ValueError, match=label):
        fold(spark, f"select 'x' as {label}, 1 as v", MetricDef(kind, "m", ""))
    with pytest.raises(ValueError, match=label):
        fold(spark, "select 1 as v", MetricDef(kind, "m", ""), labels={label: "x"})


def test_definitions_are_checked():
    with pytest.raises(ValueError, match="strictly increase"):
        MetricDef("histogram", "m", "", buckets=(1.0, 1.0))
    with pytest.raises(ValueError, match="objectives"):
        MetricDef("summary", "m", "", objectives=(1.5,))
    with pytest.raises(ValueError, match="unknown kind"):
        MetricDef("meter", "m", "")


def test_all_kinds_over_one_query_share_one_aggregation(spark):
    metrics = [
        MetricDef("gauge", "g", ""),
        MetricDef("counter", "c", ""),
        MetricDef("histogram", "h", "", buckets=(2.0,)),
        MetricDef("summary", "s", "", objectives=(0.5,), quantiles="sketch"),
    ]
    got = fold(spark, f"select g, x as v from {ROWS}", *metrics)
    assert (got["g", 'g="a"'], got["c", 'g="a"'], got["h_bucket", 'g="a",le="2"'], got["s", 'g="a",quantile="0.5"']) == (
        3.0,
        3.0,
        2.0,
        2.0,
    )


def test_sketch_error_is_below_the_objectives(spark):
    df = spark.range(0, 50000).selectExpr("id % 2 as g", "cast((id * 7919) % 50000 as double) as v")
    m = MetricDef("summary", "m", "", objectives=(0.001, 0.5, 0.99))
    for r in flat(fold_rows(to_rows(df), [(m, "m")])).where("suffix = ''").collect():
        q = float(r.labels.split('quantile="')[1][:-1])
        assert abs(r.value / 50000 - q) <= 0.0005
