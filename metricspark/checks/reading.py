"""Sources, snapshots and the text output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.checks import oracle as o
from metricspark.checks.harness import check, rounded, samples, table, tables
from metricspark.defs import MetricDef, Package, SourceDef
from metricspark.operators.folds import flat
from metricspark.plans.exposition import render
from metricspark.plans.package import run_package
from metricspark.publish import read_published
from metricspark.session import new_work_path, work_path
from metricspark.sources import read_source, refresh_source, register_sources
from metricspark.sources.incremental import IncrementalMetrics
from metricspark.sources.register import forget_snapshots

EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, props string"
EVENT_COLUMNS = ("event_id", "user_id", "event_type", "value", "props")
EVENTS_SQL = "select event_id, user_id, event_type, value, props from events"

BY_FLAG = "select l_returnflag, count(*) as n, sum(l_linenumber) as lines from lineitem group by l_returnflag"
BY_FLAG_ORACLE = """select l_returnflag, count(*) as n, cast(sum(l_linenumber) as bigint) as lines
from lineitem group by l_returnflag"""


def _parquet(sf_dir: str, name: str, **kw) -> SourceDef:
    return SourceDef(name, "parquet", f"{sf_dir}/{name}.parquet", **kw)


@check("a01_parquet_scan", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_source(spark, _parquet(sf_dir, "orders"))
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@check("a02_csv_scan", EVENTS_SQL)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_path(spark, "csv")
    table(spark, sf_dir, "events").select(*EVENT_COLUMNS).write.option("header", True).csv(path)
    return read_source(spark, SourceDef("events_csv", "csv", path, schema=EVENT_SCHEMA))


@check("a02_csv_inferred", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_path(spark, "csv")
    table(spark, sf_dir, "events").select(*EVENT_COLUMNS).write.option("header", True).csv(path)
    events = read_source(spark, SourceDef("events_csv", "csv", path))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@check("a02_csv_headerless", EVENTS_SQL)
def csv_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a header, of another delimiter: every line is a row."""
    path = new_work_path(spark, "csv")
    table(spark, sf_dir, "events").select(*EVENT_COLUMNS).write.option("header", False).option("sep", ";").csv(path)
    options = {"header": False, "sep": ";"}
    return read_source(spark, SourceDef("events_csv", "csv", path, schema=EVENT_SCHEMA, options=options))


@check("a03_json_arrays", EVENTS_SQL)
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold an array each: every element is a row."""
    path = new_work_path(spark, "json")
    some = F.to_json(F.collect_list(F.struct(*EVENT_COLUMNS))).alias("value")
    table(spark, sf_dir, "events").groupBy(F.expr("event_id div 20")).agg(some).select("value").write.text(path)
    return read_source(spark, SourceDef("events_json", "json", path, schema=EVENT_SCHEMA))


@check("a03_json_scan", EVENTS_SQL)
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_path(spark, "json")
    table(spark, sf_dir, "events").select(*EVENT_COLUMNS).write.json(path)
    return read_source(spark, SourceDef("events_json", "json", path, schema=EVENT_SCHEMA))


@check(
    "a03_json_nested",
    "select event_type, cast(sum(user_id) as bigint) as users, cast(sum(cast(props->>'k' as bigint)) as bigint) as ks "
    "from events group by all",
)
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_path(spark, "json")
    nested = table(spark, sf_dir, "events").select(
        "event_type", F.struct("user_id", F.from_json("props", "k bigint").alias("props")).alias("who")
    )
    nested.write.json(path)
    read_source(spark, SourceDef("events_nested", "json", path)).createOrReplaceTempView("events_nested")
    return spark.sql(
        "select event_type, sum(who.user_id) as users, sum(who.props.k) as ks from events_nested group by all"
    )


@check("a04_sql_source", BY_FLAG_ORACLE)
def sql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, [_parquet(sf_dir, "lineitem"), SourceDef("by_flag", "no-such-type", BY_FLAG)])
    return spark.table("by_flag")


@check("a05_materialized_source", BY_FLAG_ORACLE)
def materialized_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    forget_snapshots(spark)
    register_sources(spark, [_parquet(sf_dir, "lineitem"), SourceDef("by_flag", "sql", BY_FLAG, materialize=True)])
    return spark.table("by_flag")


@check("a06_view_source", BY_FLAG_ORACLE)
def view_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, [_parquet(sf_dir, "lineitem")])
    return spark.sql(BY_FLAG)


@check("a07_refresh", "select event_type, count(*) * 2 as n from events group by event_type")
def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot taken before its input doubles, then refreshed."""
    forget_snapshots(spark)
    once = "select event_type from events"
    growing = SourceDef("growing", "sql", "select * from input", materialize=True, refresh_interval_seconds=60)
    tables(spark, sf_dir, "events")
    spark.sql(once).createOrReplaceTempView("input")
    register_sources(spark, [growing], now=0.0)
    spark.sql(f"{once} union all {once}").createOrReplaceTempView("input")
    register_sources(spark, [growing], now=30.0)
    register_sources(spark, [growing], now=60.0)
    return spark.sql("select event_type, count(*) as n from growing group by event_type")


@check("a07_refresh_now", "select event_type, count(*) as n from events group by event_type")
def refresh_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    forget_snapshots(spark)
    d = _parquet(sf_dir, "events", materialize=True)
    refresh_source(spark, d)
    refresh_source(spark, d)
    return spark.table("events").groupBy("event_type").agg(F.count("*").alias("n"))


WHOLE_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENT_BOUNDS = (1.0, 10.0, 100.0)


@check(
    "a07_incremental_refresh",
    o.union(
        o.counter("seen", {"kind": o.text("event_type")}, "events"),
        o.gauge("greatest", {"kind": o.text("event_type")}, "a", "(select event_type, max(value) as a from events group by all) g"),
        o.histogram("spent", {"kind": o.text("event_type")}, "value", "events", EVENT_BOUNDS),
    ),
)
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come in three parts, with a refresh after each that reads the new files and merges their states."""
    path, events = new_work_path(spark, "growing"), table(spark, sf_dir, "events")
    metrics = [
        (MetricDef("counter", "seen"), "seen"),
        (MetricDef("gauge", "greatest"), "greatest"),
        (MetricDef("histogram", "spent", buckets=EVENT_BOUNDS), "spent"),
    ]
    source = SourceDef("arriving", "parquet", path, schema=WHOLE_EVENTS)
    query = "select event_type as kind, value as v from arriving"
    growing = IncrementalMetrics(spark, source, query, metrics, new_work_path(spark, "growing-states"))
    for i in range(3):
        events.where(f"event_id % 3 = {i}").write.mode("append").parquet(path)
        growing.refresh()
    return rounded(flat(growing.samples()))


@check(
    "a08_source_list",
    "select count(*) as flags, cast(sum(n) as bigint) as n from (select l_returnflag, count(*) as n from lineitem group by all)",
)
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = "select count(*) as flags, sum(n) as n from by_flag"
    register_sources(
        spark, [_parquet(sf_dir, "lineitem"), SourceDef("by_flag", "sql", BY_FLAG), SourceDef("totals", "sql", totals)]
    )
    return spark.table("totals")


QUANTITY_METRICS = {
    "gauge": [
        {
            "name": "lines",
            "help": "Lines\nby flag",
            "sql": "select l_returnflag as flag, l_linestatus as status, count(*) as value from lineitem group by all",
        }
    ],
    "histogram": [
        {"name": "quantity", "sql": "select l_returnflag as flag, l_quantity as v from lineitem", "buckets": [10, 20, 50]}
    ],
    "summary": [
        {"name": "quantity_q", "sql": "select l_returnflag as flag, l_quantity as v from lineitem", "objectives": [0.5, 0.99]}
    ],
    "counter": [{"name": "seen", "help": "All lines", "sql": "select l_orderkey as value from lineitem"}],
}


def _exposition_oracle() -> str:
    number = o.whole_number_text("value")
    flag = "'flag=\"' || l_returnflag || '\"'"

    def lines(suffix: str, extra: str, agg: str, name: str) -> str:
        return (
            f"select '{name}' as name, '{name}{suffix}{{' || {flag} || '{extra}}} ' || {number} as line from "
            f"(select l_returnflag, {agg} as value from lineitem group by l_returnflag)"
        )

    heads = [
        ("shop_lines", "Lines\\\\nby flag", "gauge"),
        ("shop_quantity", "", "histogram"),
        ("shop_quantity_q", "", "summary"),
        ("shop_seen", "All lines", "counter"),
    ]
    parts = []
    for name, help_text, kind in heads:
        help_text = help_text.replace("\\\\", "\\")
        parts.append(f"select '{name}' as name, '# HELP {name} {help_text}' as line")
        parts.append(f"select '{name}', '# TYPE {name} {kind}'")
    parts.append(
        f"select 'shop_lines', 'shop_lines{{' || {flag} || ',status=\"' || l_linestatus || '\"}} ' || {number} "
        "from (select l_returnflag, l_linestatus, count(*) as value from lineitem group by all)"
    )
    for bound in (10, 20, 50):
        parts.append(
            lines("_bucket", f',le="{bound}"', f"count(*) filter (where l_quantity <= {bound})", "shop_quantity")
        )
    parts.append(lines("_bucket", ',le="+Inf"', "count(*)", "shop_quantity"))
    for q in (0.5, 0.99):
        parts.append(lines("", f',quantile="{q}"', f"quantile_disc(l_quantity, {q})", "shop_quantity_q"))
    for name in ("shop_quantity", "shop_quantity_q"):
        parts.append(lines("_sum", "", "sum(l_quantity)", name))
        parts.append(lines("_count", "", "count(*)", name))
    parts.append(f"select 'shop_seen', 'shop_seen ' || {number} from (select count(*) as value from lineitem)")
    return "\nunion all\n".join(parts)


@check("a09_exposition", _exposition_oracle())
def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    run = run_package(spark, Package.from_dict({"name": "shop", "metrics": QUANTITY_METRICS}))
    return render(run.samples).select("name", "line")


@check(
    "a09_written_samples",
    o.gauge("shop_lines", {"flag": "f"}, "a", "(select l_returnflag as f, count(*) as a from lineitem group by all) g"),
)
def written_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as a table and read back."""
    tables(spark, sf_dir, "lineitem")
    sql = "select l_returnflag as flag, count(*) as value from lineitem group by all"
    run = run_package(spark, Package.from_dict({"name": "shop", "metrics": {"gauge": [{"name": "lines", "sql": sql}]}}))
    path = work_path(spark, "samples")
    run.write(path)
    run.parts = {"written": read_published(spark, path)}
    return samples(run)


ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


@check("c02_arrow_source", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def arrow_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by tasks as Arrow files of several batches each, then read back."""
    path = new_work_path(spark, "arrow").removeprefix("file:")
    names = [c.split()[0] for c in ORDER_SCHEMA.split(", ")]

    def write(batches):
        import os
        import uuid

        from pyarrow import fs

        where, inner = (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path)
        where.create_dir(inner, recursive=True)
        n = 0
        out, writer = None, None
        for batch in batches:
            if writer is None:
                out = where.open_output_stream(os.path.join(inner, f"{uuid.uuid4().hex}.arrow"))
                writer = pa.ipc.new_file(out, batch.schema)
            for start in range(0, batch.num_rows, 1000):
                writer.write_batch(batch.slice(start, 1000))
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    table(spark, sf_dir, "orders").select(*names).mapInArrow(write, "n long").agg(F.sum("n")).first()
    return read_source(spark, SourceDef("orders_arrow", "arrow", path, schema=ORDER_SCHEMA))
