"""One rank rule at every size, and names that packages or kinds share."""

from fractions import Fraction
from math import ceil

import pytest
from pyspark.sql import functions as F

from metricspark.defs import Package
from metricspark.operators.quantiles import exact_quantiles
from metricspark.plans.exposition import render
from metricspark.plans.package import run_packages
from metricspark.sources.arrow import read_arrow


@pytest.mark.parametrize("n", [15, 30_000])
def test_long_objectives_on_both_paths(spark, n):
    qs = [2 / 3, 1 / 3, 1 / 7, 0.07, 0.50000000001, 1.0]
    rows = spark.range(1, n + 1).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    want = [max(1, ceil(Fraction(repr(q)) * n)) for q in qs]
    for accuracy in (10, 100_000):
        found = exact_quantiles(rows, ["k"], "v", qs, accuracy=accuracy).first()
        assert [found[f"q_{i}"] for i in range(len(qs))] == want


def test_a_shared_name_costs_only_the_later_metrics(spark):
    def package(name, value, **kinds):
        listed = {k: [{"name": m, "sql": f"select {value} as value"} for m in names] for k, names in kinds.items()}
        return Package.from_dict({"name": name, "metricPrefix": "", "metrics": listed})

    first = package("shop", 9, gauge=["x", "good"], counter=["x"])
    run = run_packages(spark, [first, package("shop", 10, gauge=["x", "other"])])
    assert sorted((r.name, r.value) for r in run.samples.collect()) == [("shop_good", 9.0), ("shop_other", 10.0), ("shop_x", 9.0)]
    assert len(run.errors) == 2
    twice = run.samples.unionByName(run.samples.withColumn("value", F.col("value") + 1))
    assert render(twice).where("line not like '#%'").count() == 6


def test_arrow_batches_are_read_by_many_tasks(spark, tmp_path):
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64())])
    with pa.ipc.new_file(str(tmp_path / "x.arrow"), schema) as f:
        for i in range(40):
            f.write_batch(pa.record_batch([pa.array([i])], schema=schema))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    rows = read_arrow(spark, str(tmp_path / "*.arrow"), "a long")
    assert rows.select(F.spark_partition_id()).distinct().count() >= 3
