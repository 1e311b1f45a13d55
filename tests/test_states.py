"""Stored states: any split of the rows merges to the same samples, and refreshes read new files only."""

import pytest
from pyspark.sql import functions as F

from metricspark.defs import MetricDef, SourceDef
from metricspark.operators.folds import flat, fold_rows
from metricspark.operators.samples import to_rows
from metricspark.operators.states import make_states, merge_states, rank_error, sketch_size, state_samples
from metricspark.sources.incremental import IncrementalMetrics

METRICS = [
    (MetricDef("counter", "c"), "c"),
    (MetricDef("histogram", "h", buckets=(1.0, 5.0)), "h"),
    (MetricDef("summary", "s", objectives=(0.1, 0.5), quantiles="sketch"), "s"),
    (MetricDef("gauge", "g"), "g"),
]
QUERY = "select case when n % 5 = 0 then null else n % 3 end as k, cast(n % 17 as double) / 2 as v from state_rows"


def found(samples):
    return sorted((r.name, r.suffix, r.labels, r.value) for r in flat(samples).collect())


def write(spark, path, first, end, **columns):
    spark.range(first, end, numPartitions=1).select(F.col("id").alias("n")).write.mode("append").parquet(path)


def whole(spark, path):
    spark.read.parquet(path).createOrReplaceTempView("state_rows")
    return found(fold_rows(to_rows(spark.sql(QUERY)), METRICS))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_states_of_parts_are_the_state_of_all(spark, parts):
    spark.range(300).selectExpr("id as n").createOrReplaceTempView("state_rows")
    rows = to_rows(spark.sql(QUERY))
    states = None
    for i in range(parts):
        some = to_rows(spark.sql(f"{QUERY} where n % {parts} = {i}"))
        new = make_states(some, METRICS)
        states = new if states is None else states.union(new)
    assert found(state_samples(states, rows, METRICS)) == found(fold_rows(rows, METRICS))


def test_the_last_row_by_another_column_survives_merging(spark):
    m = [(MetricDef("gauge", "g", order_by="n"), "g")]
    parts = [to_rows(spark.sql(f"select id as n, 10 - id as v, 'a' as k from range({a}, {a + 4})"), "n") for a in (4, 0)]
    states = make_states(parts[0], m).union(make_states(parts[1], m))
    assert found(state_samples(states, parts[0], m)) == [("g", "", 'k="a"', 3.0)]


def test_merged_sketches_keep_their_rank_error(spark):
    qs = (0.01, 0.5, 0.99)
    m = [(MetricDef("summary", "s", objectives=qs, quantiles="sketch"), "s")]
    rows = to_rows(spark.sql("select id % 24 as hour, pow(1.0001, (id * 7919) % 100000) as v from range(100000)"))
    hours = make_states(rows, m)
    day = merge_states(hours, [], m).select(*[F.kll_sketch_get_quantile_double("m0_sketch", F.lit(q)) for q in qs]).first()
    error = rank_error(sketch_size(qs))
    assert error <= 0.001
    for q, v in zip(qs, day):
        rank = rows.frame.where(F.col("sample_value") <= v).count() / 100000
        assert abs(rank - q) <= 3 * error


def test_groups_cannot_be_merged(spark):
    rows = to_rows(spark.sql("select id % 3 as k, count(1) as v from range(9) group by 1"))
    with pytest.raises(ValueError, match="groups"):
        make_states(rows, METRICS[:1])


def metrics_of(spark, path, tmp_path):
    source = SourceDef("state_rows", "parquet", path, schema="n bigint")
    return IncrementalMetrics(spark, source, QUERY, METRICS, str(tmp_path / "states"))


def test_a_refresh_reads_new_files_only(spark, tmp_path):
    path = str(tmp_path / "rows [a]*{b}")
    growing = metrics_of(spark, path.replace("[", "\\[").replace("]", "\\]").replace("*", "\\*").replace("{", "\\{").replace("}", "\\}"), tmp_path)
    write(spark, path, 0, 100)
    first = growing.refresh()
    assert len(first.read) == 1 and first.anew
    assert growing.refresh().read == ()
    for i in range(1, 4):
        write(spark, path, 100 * i, 100 * i + 70)
        done = growing.refresh()
        assert len(done.read) == 1 and not done.anew and done.read[0] not in first.read
        assert found(growing.samples()) == whole(spark, path.replace("[", "\\[").replace("]", "\\]").replace("*", "\\*").replace("{", "\\{").replace("}", "\\}"))


def test_removed_and_changed_files_are_counted_anew(spark, tmp_path):
    path = str(tmp_path / "rows")
    growing = metrics_of(spark, path, tmp_path)
    for i in range(3):
        write(spark, path, 50 * i, 50 * i + 50)
    assert len(growing.refresh().read) == 3
    one = sorted((tmp_path / "rows").glob("*.parquet"))[0]
    one.unlink()
    again = growing.refresh()
    assert again.anew and len(again.read) == 2
    spark.catalog.clearCache()
    assert found(growing.samples()) == whole(spark, path)
    two = sorted((tmp_path / "rows").glob("*.parquet"))
    two[0].write_bytes(two[1].read_bytes())
    for crc in (tmp_path / "rows").glob(".*.crc"):
        crc.unlink()
    assert growing.refresh().anew
    assert found(growing.samples()) == whole(spark, path)


def test_nothing_yet_and_labels(spark, tmp_path):
    path = str(tmp_path / "rows")
    (tmp_path / "rows").mkdir()
    growing = metrics_of(spark, path, tmp_path)
    assert growing.samples().collect() == []
    assert growing.refresh().read == ()
    assert growing.samples().collect() == []
    write(spark, path, 0, 5)
    growing.refresh()
    assert all(r.labels["env"] == "t" for r in growing.samples({"env": "t"}).collect())


def test_sources_that_cannot_grow(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        IncrementalMetrics(spark, SourceDef("x", "parquet", "p"), QUERY, METRICS, str(tmp_path))
    with pytest.raises(ValueError, match="type"):
        IncrementalMetrics(spark, SourceDef("x", "sql", "p", schema="n bigint"), QUERY, METRICS, str(tmp_path))
