"""What the plans of the hot paths look like: pruned and pushed down scans, one shuffle, no Python."""

import re

import pytest
from pyspark.sql import functions as F

from metricspark.defs import MetricDef
from metricspark.functions.text import bm25
from metricspark.operators.enrich import add_labels
from metricspark.operators.folds import fold_rows
from metricspark.operators.quantiles import exact_quantiles, frequency_quantiles
from metricspark.operators.samples import to_rows
from metricspark.plans.exposition import render


@pytest.fixture
def lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(1000).selectExpr(
        "concat('f', id % 3) as flag", "id % 7 as line", "cast(id as double) as price", "cast(id as string) as note"
    ).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("plan_lines")


def plan(df):
    df = df.select("*")
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def count(text, what):
    return len(re.findall(what, text))


@pytest.mark.parametrize(
    "metric",
    [
        MetricDef("gauge", "m", ""),
        MetricDef("counter", "m", ""),
        MetricDef("histogram", "m", "", buckets=tuple(float(2**i) for i in range(15))),
        MetricDef("summary", "m", "", objectives=(0.5, 0.99), quantiles="sketch"),
    ],
)
def test_a_fold_is_one_scan_and_one_shuffle(spark, lines, metric):
    rows = to_rows(spark.sql("select flag, line, price as v from plan_lines where price > 10"))
    text = plan(fold_rows(rows, [(metric, "m")], {"env": "t"}))
    assert count(text, "FileScan") == 1 and count(text, "Exchange hashpartitioning") == 1
    assert "partial_" in text and "Python" not in text
    assert "GreaterThan(price,10.0)" in text
    assert "note" not in text


def test_metrics_over_one_query_share_scan_and_shuffle(spark, lines):
    metrics = [
        MetricDef("gauge", "g", ""),
        MetricDef("counter", "c", ""),
        MetricDef("histogram", "h", ""),
        MetricDef("summary", "s", "", objectives=(0.5,), quantiles="sketch"),
    ]
    rows = to_rows(spark.sql("select flag, price as v from plan_lines"))
    text = plan(fold_rows(rows, [(m, m.name) for m in metrics]))
    assert count(text, "FileScan") == 1 and count(text, "Exchange") == 1


def test_labels_group_by_their_own_type(spark, lines):
    text = plan(fold_rows(to_rows(spark.sql("select line, price as v from plan_lines")), [(MetricDef("counter", "c", ""), "c")]))
    shuffled = re.search(r"Exchange hashpartitioning\((key_0#\d+L),", text)
    assert shuffled, "a whole number label is shuffled as a number"


def test_a_query_grouped_by_its_label_is_not_shuffled_again(spark, lines):
    rows = to_rows(spark.sql("select line, sum(price) as v from plan_lines group by line"))
    assert count(plan(fold_rows(rows, [(MetricDef("gauge", "g", ""), "g")])), "Exchange") == 1


def test_exact_quantiles_scan_a_second_time_and_shuffle_counts_only(spark, lines):
    text = plan(exact_quantiles(spark.table("plan_lines").select("flag", "price"), ["flag"], "price", (0.5, 0.9)))
    # counts per value go by all keys first, then what is left of them by series
    assert count(text, "FileScan") == 1 and count(text, "Exchange hashpartitioning") == 2
    assert "partial_count" in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("limits", [{}, {"accuracy": 20}, {"accuracy": 20, "rank_rows": 3}])
def test_exact_quantiles_read_every_row_twice(spark, limits):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(v):
        read.add(1)
        return v

    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), noted(F.col("id").cast("double")).alias("v"))
    exact_quantiles(rows, ["k"], "v", (0.01, 0.5, 0.99), **limits).collect()
    assert read.value == 6000


def test_groups_are_ranked_in_one_evaluation_without_a_checkpoint(spark, lines):
    rows = to_rows(spark.sql("select flag, line, count(1) as n from plan_lines group by all").select("flag", F.col("n").alias("v")))
    assert rows.grouped and not to_rows(spark.sql("select flag, price as v from plan_lines")).grouped
    text = plan(frequency_quantiles(rows.frame, rows.keys, "sample_value", (0.5, 0.9)))
    assert count(text, "FileScan") == 1 and "ExistingRDD" not in text


def test_rendering_computes_the_samples_once(spark, lines):
    samples = fold_rows(to_rows(spark.sql("select flag, price as v from plan_lines")), [(MetricDef("counter", "c", ""), "c")])
    assert count(plan(render(samples)), "FileScan") == 1


def test_a_small_dimension_is_broadcast_and_a_large_one_is_not(spark, lines):
    facts = spark.table("plan_lines")
    dim = facts.select("line", F.col("note").alias("name"))
    assert "BroadcastHashJoin" in plan(add_labels(facts, dim, ["line"], ["name"]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in plan(add_labels(facts, dim, ["line"], ["name"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_full_text_scores_do_not_shuffle_texts(spark, lines):
    text = plan(bm25(spark.table("plan_lines"), "line", "note", ["the"]))
    assert "hashpartitioning" not in text and "Join" not in text and "Python" not in text
    # the words were extracted when the counts were kept
    assert "regexp_extract_all" not in text and "FileScan" not in text
