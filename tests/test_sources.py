import os
import subprocess
import sys

import pyarrow as pa
import pytest

from metricspark.defs import SourceDef
from metricspark.sources import read_source, refresh_source, register_sources
from metricspark.sources.jdbc import jdbc_options
from metricspark.sources.register import RefreshError


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_types_are_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,one,1.5\n2,two,\n")
    df = read_source(spark, SourceDef("s", "csv", str(tmp_path)))
    assert [t for _, t in df.dtypes] == ["int", "string", "double"]
    assert rows(df) == [(1, "one", 1.5), (2, "two", None)]


def test_csv_with_schema_and_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;one\n")
    d = SourceDef("s", "csv", str(tmp_path), schema="id bigint, name string", options={"sep": ";", "header": False})
    assert rows(read_source(spark, d)) == [(1, "one")]


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": {"b": 1}}\n{"a": {"b": 2}}\n')
    (tmp_path / "array.json").write_text('[{"a": {"b": 1}},\n {"a": {"b": 2}}]')
    lines = read_source(spark, SourceDef("s", "json", str(tmp_path / "lines.json")))
    array = read_source(spark, SourceDef("s", "json", str(tmp_path / "array.json"), options={"multiLine": True}))
    assert rows(lines.select("a.b")) == rows(array.select("a.b")) == [(1,), (2,)]


def test_parquet_glob(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).write.parquet(str(tmp_path / f"part{i}"))
    assert rows(read_source(spark, SourceDef("s", "parquet", str(tmp_path / "part*")))) == [(0,), (1,), (2,)]


def test_unknown_type_is_sql_and_sees_earlier_sources(spark):
    register_sources(spark, [SourceDef("s_one", "sql", "select 1 as x;"), SourceDef("s_two", "??", "select x + 1 as x from s_one")])
    assert rows(spark.table("s_two")) == [(2,)]


def test_registration_stops_at_the_first_error(spark):
    with pytest.raises(Exception, match="no_such_table"):
        register_sources(spark, [SourceDef("s_bad", "sql", "select * from no_such_table"), SourceDef("s_after", "sql", "select 1")])
    assert not spark.catalog.tableExists("s_after")


def test_sql_variables(spark):
    d = SourceDef("s", "sql", "select id from range(10) where id >= :low")
    assert rows(read_source(spark, d, {"low": 8, "unused": 1})) == [(8,), (9,)]


def test_views_see_new_files_and_snapshots_do_not(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2).write.parquet(path)
    view = SourceDef("s_view", "parquet", path)
    snap = SourceDef("s_snap", "parquet", path, materialize=True, refresh_interval_seconds=60)
    register_sources(spark, [view, snap], now=0.0)
    spark.range(5).write.mode("append").parquet(path)
    assert register_sources(spark, [view, snap], now=59.0) == {}
    assert (spark.table("s_view").count(), spark.table("s_snap").count()) == (7, 2)
    register_sources(spark, [view, snap], now=60.0)
    assert spark.table("s_snap").count() == 7


def test_snapshot_without_interval_is_refreshed_only_on_request(spark):
    d = SourceDef("s_fixed", "sql", "select * from s_input", materialize=True)
    spark.range(1).createOrReplaceTempView("s_input")
    register_sources(spark, [d], now=0.0)
    spark.range(2).createOrReplaceTempView("s_input")
    register_sources(spark, [d], now=1e9)
    assert spark.table("s_fixed").count() == 1
    refresh_source(spark, d)
    assert spark.table("s_fixed").count() == 2


def test_a_changed_definition_is_another_snapshot(spark):
    first = SourceDef("s_same", "sql", "select 1 as x", materialize=True)
    second = SourceDef("s_same", "sql", "select 2 as x", materialize=True)
    for d, want in ((first, 1), (second, 2), (first, 1)):
        register_sources(spark, [d], now=0.0)
        assert rows(spark.table("s_same")) == [(want,)]
    by_variable = SourceDef("s_same", "sql", "select :n as x", materialize=True)
    for n in (5, 6):
        register_sources(spark, [by_variable], {"n": n}, now=0.0)
        assert rows(spark.table("s_same")) == [(n,)]


def test_snapshots_are_shown_in_every_session(spark):
    d = SourceDef("s_sessions", "sql", "select 1 as x", materialize=True)
    register_sources(spark, [d])
    other = spark.newSession()
    register_sources(other, [d])
    assert rows(other.table("s_sessions")) == [(1,)]


def test_failed_refresh_keeps_the_snapshot(spark):
    d = SourceDef("s_kept", "sql", "select id from s_gone", materialize=True, refresh_interval_seconds=1)
    spark.range(3).createOrReplaceTempView("s_gone")
    register_sources(spark, [d], now=0.0)
    spark.catalog.dropTempView("s_gone")
    assert "s_kept" in register_sources(spark, [d], now=10.0)
    with pytest.raises(RefreshError):
        refresh_source(spark, d)
    # fails while it runs, not when it is planned
    spark.sql("select raise_error('broken') as id").createOrReplaceTempView("s_gone")
    assert "broken" in register_sources(spark, [d], now=20.0)["s_kept"]
    assert spark.table("s_kept").count() == 3


def test_reader_of_the_previous_snapshot_is_not_disturbed(spark):
    d = SourceDef("s_turn", "sql", "select id from s_turn_input", materialize=True)
    spark.range(3).createOrReplaceTempView("s_turn_input")
    refresh_source(spark, d)
    reading = spark.table("s_turn").select("id")
    spark.range(4).createOrReplaceTempView("s_turn_input")
    refresh_source(spark, d)
    assert (reading.count(), spark.table("s_turn").count()) == (3, 4)


def test_jdbc_options():
    split = {"partitionColumn": "id", "lowerBound": 0, "upperBound": 100, "numPartitions": 8}
    d = SourceDef("s", "jdbc", "orders", options={"url": "jdbc:x:y", **split})
    assert jdbc_options(d) == {
        "dbtable": "orders",
        "fetchsize": "10000",
        "url": "jdbc:x:y",
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "100",
        "numPartitions": "8",
    }
    with pytest.raises(ValueError, match="url"):
        jdbc_options(SourceDef("s", "jdbc", "orders"))
    with pytest.raises(ValueError, match="numPartitions, upperBound"):
        jdbc_options(SourceDef("s", "jdbc", "t", options={"url": "u", "partitionColumn": "id", "lowerBound": 0}))


def test_jdbc_reads_that_one_task_would_do_must_be_asked_for():
    with pytest.raises(ValueError, match="singleConnection"):
        jdbc_options(SourceDef("s", "jdbc", "t", options={"url": "u"}))
    small = jdbc_options(SourceDef("s", "jdbc", "t", options={"url": "u", "singleConnection": True}))
    assert small == {"dbtable": "t", "fetchsize": "10000", "url": "u"}


def test_import_without_pyarrow():
    code = "import sys; sys.modules['pyarrow'] = None; import metricspark"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_arrow_files_and_streams(spark, tmp_path):
    batches = [pa.record_batch({"id": pa.array(range(i * 10, i * 10 + 10), pa.int32()), "s": ["x"] * 10}) for i in range(5)]
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as f, pa.ipc.new_stream(f, batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)
    d = SourceDef("s", "arrow", str(tmp_path), schema="s string, id bigint")
    df = read_source(spark, d)
    assert df.dtypes == [("s", "string"), ("id", "bigint")]
    assert rows(df) == sorted([("x", i) for i in range(50)] * 2)
    with pytest.raises(ValueError, match="schema"):
        read_source(spark, SourceDef("s", "arrow", str(tmp_path)))
