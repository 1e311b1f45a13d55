"""Metrics that name a source: one aggregation for all of them gives what each gives by itself."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from metricspark.defs import MetricDef, Package
from metricspark.operators.folds import flat
from metricspark.plans.package import run_package
from metricspark.publish import read_published

BY = {"k": "k", "half": "n % 2"}
METRICS = {
    "gauge": [
        {"name": "all", "from": "fused_rows", "value": "count(1)"},
        {"name": "none", "from": "fused_rows", "where": "n > 1000", "value": "sum(x)"},
        {"name": "sums", "from": "fused_rows", "by": {"k": "k"}, "value": "sum(x)"},
        {"name": "some", "from": "fused_rows", "where": "x > 5", "by": {"key": "k"}, "value": "max(x)"},
        {"name": "two", "from": "fused_rows", "by": BY, "value": "avg(x)"},
        {"name": "best", "from": "fused_rows", "where": "n > 3", "by": {"n": "n"}, "value": "sum(x)", "top": 3},
        {"name": "listed", "from": "fused_rows", "by": {"l": "array(n % 3)"}, "value": "min(flag)"},
    ],
    "counter": [{"name": "seen", "from": "fused_rows", "where": "x is not null", "by": BY}],
    "histogram": [{"name": "spread", "from": "fused_rows", "by": {"k": "k"}, "value": "x", "buckets": [1, 5, 10]}],
    "summary": [
        {"name": "exact", "from": "fused_rows", "by": {"k": "k"}, "value": "x", "objectives": [0.1, 0.5, 1]},
        {"name": "other", "from": "fused_rows", "where": "n > 5", "by": {"k": "k"}, "value": "n", "objectives": [0.9]},
        {"name": "plain", "from": "fused_rows", "value": "x", "objectives": [0.25]},
        {"name": "groups", "from": "fused_rows", "by": {"k": "k"}, "each": ["n % 4"], "value": "count(1)", "objectives": [0.5]},
        {"name": "sketched", "from": "fused_rows", "by": {"k": "k"}, "value": "x", "objectives": [0.5], "quantiles": "sketch"},
        {"name": "totals", "from": "fused_rows", "by": BY, "value": "x"},
    ],
}


def rows(spark, n=60):
    k = "case when id % 7 = 0 then null else concat('k', id % 3) end as k"
    x = "case when id % 11 = 0 then null else cast(id % 13 as double) / 2 end as x"
    return spark.range(n).selectExpr(k, "cast(id % 20 as int) as n", x, "id % 2 = 0 as flag")


def found(run):
    assert not run.errors
    return sorted((r.name, r.kind, r.suffix, r.labels, round(r.value, 9)) for r in flat(run.samples).collect())


@pytest.mark.parametrize("labels", [None, {"env": "t", "k": "fixed"}])
@pytest.mark.parametrize("n", [60, 1, 0])
def test_together_as_apart(spark, n, labels):
    rows(spark, n).createOrReplaceTempView("fused_rows")
    package = Package.from_dict({"name": "p", "metrics": METRICS})
    apart = [found(run_package(spark, replace(package, metrics=(m,)), labels)) for m in package.metrics]
    together = run_package(spark, package, labels)
    assert found(together) == sorted(x for some in apart for x in some)
    together.close()


def test_a_source_is_read_twice(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        read.add(1)
        return x

    rows(spark, 400).repartition(3).withColumn("x", noted("x")).createOrReplaceTempView("fused_rows")
    with run_package(spark, Package.from_dict({"name": "p", "metrics": METRICS})) as run:
        run.samples.collect()
    # the summaries of rows have two groupings, each of which is ranked by a scan
    assert read.value == 3 * 400
    read.value = 0
    some = {k: [m for m in ms if m["name"] != "plain"] for k, ms in METRICS.items()}
    with run_package(spark, Package.from_dict({"name": "p", "metrics": some})) as run:
        run.samples.collect()
    assert read.value == 2 * 400


def test_variables_and_macros_reach_all_expressions(spark):
    rows(spark).createOrReplaceTempView("fused_rows")
    metrics = [
        {"name": "a", "from": "fused_rows", "where": "n >= :least", "value": "sum(twice_fused(x))"},
        {"name": "b", "from": "fused_rows", "where": "n < :least", "by": {"n": "n + :least"}, "value": "count(1)"},
    ]
    given = {"name": "p", "metrics": {"gauge": metrics}, "macros": [{"sql": "twice_fused(x double) returns double return 2 * x"}]}
    got = found(run_package(spark, Package.from_dict(given, {"least": 15})))
    all_rows = rows(spark).collect()
    assert got[0][-1] == sum(2 * (r.x or 0) for r in all_rows if r.n >= 15)
    assert len(got) == 1 + len({r.n for r in all_rows if r.n < 15})


def test_a_metric_that_cannot_be_planned_costs_no_other(spark):
    rows(spark).createOrReplaceTempView("fused_rows")
    metrics = [*METRICS["gauge"][:2], {"name": "bad", "from": "fused_rows", "by": {"k": "nowhere"}, "value": "count(1)"}]
    run = run_package(spark, Package.from_dict({"name": "p", "metrics": {"gauge": metrics}}))
    assert list(run.errors) == ["p_bad"] and {r.name for r in run.samples.collect()} == {"p_all", "p_none"}


def test_a_metric_that_fails_on_its_rows_costs_no_other(spark, tmp_path):
    rows(spark).createOrReplaceTempView("fused_rows")
    metrics = [*METRICS["gauge"][:3], {"name": "bad", "from": "fused_rows", "value": "sum(assert_true(n < 3) is null)::int"}]
    metrics[-1]["value"] = "sum(if(n > 3, raise_error('too large'), 1))"
    run = run_package(spark, Package.from_dict({"name": "p", "metrics": {"gauge": metrics}}))
    run.write(str(tmp_path / "out"))
    kept = {r.name for r in read_published(spark, str(tmp_path / "out")).collect()}
    assert kept == {"p_all", "p_none", "p_sums"} and list(run.errors) == ["p_bad"]


@pytest.mark.parametrize(
    "wrong",
    [
        {"sql": "select 1", "where": "x > 1"},
        {"sql": "select 1", "source": "t", "value": "count(1)"},
        {"source": "t"},
        {"source": "t", "value": "x", "each": ("y",)},
        {"kind": "summary", "source": "t", "value": "x", "top": 3},
    ],
)
def test_definitions_that_contradict_themselves(wrong):
    with pytest.raises(ValueError):
        MetricDef(**{"kind": "gauge", "name": "m", **wrong})
