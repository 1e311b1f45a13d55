"""Query results to labels and values, names and label merging."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.checks import oracle as o
from metricspark.checks.harness import check, extracted, rounded, run_metrics, samples, tables
from metricspark.defs import Config, MetricDef, Package, merge_metrics
from metricspark.operators.labels import canonical_map, label_names, merge
from metricspark.operators.samples import extract, split_columns
from metricspark.plans.package import run_config, run_package

FLAG = {"l_returnflag": o.text("l_returnflag")}
STATUS = {**FLAG, "l_linestatus": o.text("l_linestatus")}


@check(
    "a10_value_column",
    o.union(
        o.rows(FLAG, "a", "(select l_returnflag, sum(l_linenumber) as a from lineitem group by all) g"),
        o.rows(
            {**FLAG, "Value": o.text("b")},
            "a",
            "(select l_returnflag, min(l_linenumber) as b, count(*) as a from lineitem group by all) g",
        ),
    ),
)
def value_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unaliased function is the value; names are case sensitive, so `Value` is a label."""
    tables(spark, sf_dir, "lineitem")
    unaliased = spark.sql("select l_returnflag, sum(l_linenumber) from lineitem group by 1")
    by_case = spark.sql("select l_returnflag, min(l_linenumber) as Value, count(*) as val from lineitem group by 1")
    return extracted(unaliased).unionByName(extracted(by_case))


@check(
    "a11_last_value_wins",
    o.union(
        o.rows(FLAG, "m", "(select l_returnflag, max(l_tax) as m from lineitem group by all) g"),
        o.rows({**FLAG, "n": o.text("n")}, "0", "(select l_returnflag, count(*) as n from lineitem group by all) g"),
    ),
)
def last_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    several = spark.sql("select count(*) as value, l_returnflag, sum(l_tax) as v, max(l_tax) from lineitem group by 2")
    none = spark.sql("select l_returnflag, count(*) as n from lineitem group by 1")
    return extracted(several).unionByName(extracted(none))


@check(
    "a12_value_coercion",
    o.union(
        *[
            f"select '{name}' as case_name, event_id, round(coalesce({expr}, 0), 4) as value from events"
            for name, expr in [
                ("bool", "cast(cast(user_id % 2 = 0 as int) as double)"),
                ("number_text", "try_cast(props->>'k' as double)"),
                ("other_text", "0.0"),
                ("null_or_int", "cast(nullif(user_id, 8) as double)"),
                ("time", "0.0"),
                ("decimal", "cast(cast(value as decimal(18, 2)) as double)"),
            ]
        ]
    ),
)
def value_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    cases = {
        "bool": "user_id % 2 = 0",
        "number_text": "get_json_object(props, '$.k')",
        "other_text": "event_type",
        "null_or_int": "nullif(user_id, 8)",
        "time": "ts",
        "decimal": "cast(value as decimal(18, 2))",
    }
    out = None
    for name, expr in cases.items():
        rows = extract(spark.sql(f"select event_id, {expr} as value from events"))
        part = rows.select(
            F.lit(name).alias("case_name"), F.col("labels")["event_id"].cast("bigint").alias("event_id"), "value"
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@check(
    "a13_label_text",
    o.rows(
        {
            "flag": o.text("nullif(l_returnflag, 'A')"),
            "line": o.text("l_linenumber"),
            "first_line": "case when l_linenumber = 1 then 'true' else 'false' end",
            "quantity": "cast(cast(l_quantity as bigint) as varchar)",
            "discount": "case when l_discount = 0 then '0' else cast(l_discount as varchar) end",
            "shipped": "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || ' +0000 UTC'",
        },
        "1",
        "lineitem",
    ),
)
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return extracted(
        spark.sql(
            "select nullif(l_returnflag, 'A') as flag, l_linenumber as line, l_linenumber = 1 as first_line, "
            "l_quantity as quantity, l_discount as discount, l_shipdate as shipped, 1 as value from lineitem"
        )
    )


@check(
    "a13_time_label",
    o.rows(
        {"at": "cast(ts as varchar) || ' +0000 UTC'", "day": "cast(cast(ts as date) as varchar) || ' 00:00:00 +0000 UTC'"},
        "value",
        "events",
    ),
)
def time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return extracted(spark.sql("select ts as at, cast(ts as date) as day, value from events"))


@check(
    "a14_label_names",
    "select label, count(*) as n from (select unnest(['l_returnflag', 'status']) as label from lineitem) group by all",
)
def discovered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label names are known from the query alone; counted here over all its rows."""
    tables(spark, sf_dir, "lineitem")
    df = spark.sql("select l_returnflag, lower(l_linestatus) as status, abs(l_tax), l_tax as val from lineitem")
    found = extract(df).select(F.explode(F.map_keys("labels")).alias("label"))
    return found.groupBy("label").agg(F.count("*").alias("n"))


@check("a15_extract", o.rows(STATUS, "l_extendedprice", "lineitem"))
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return extracted(spark.sql("select l_returnflag, l_linestatus, l_extendedprice as value from lineitem"))


@check("a16_label_map", "select o_orderpriority as priority, o_orderstatus as status, count(*) as n from orders group by all")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders")
    rows = extract(spark.sql("select o_orderpriority, o_orderstatus, o_totalprice as v from orders"))
    labels = F.col("labels")
    return rows.groupBy(
        labels["o_orderpriority"].alias("priority"), labels["o_orderstatus"].alias("status")
    ).agg(F.count("*").alias("n"))


LINES_SQL = "select l_returnflag, l_linestatus, count(*) as value from lineitem group by all"
LINES = [{"name": "lines", "sql": LINES_SQL}]
LINES_GROUP = "(select l_returnflag, l_linestatus, count(*) as a from lineitem group by all) g"
ENV = {"env": "'test'"}


@check("a22_full_name", o.gauge("acme_big_shop_lines", STATUS, "a", LINES_GROUP))
def full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    p = Package.from_dict({"name": "big-shop", "metrics": {"gauge": LINES}}, prefix="acme_")
    return samples(run_package(spark, p))


@check(
    "a23_label_names",
    "select label, count(*) as n from (select unnest(['l_returnflag', 'l_linestatus', 'env']) as label from "
    "(select distinct l_returnflag, l_linestatus from lineitem)) group by all",
)
def all_label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    p = Package.from_dict({"name": "shop", "metrics": {"gauge": LINES}})
    run = run_package(spark, p, {"env": "test"})
    query_labels, _ = split_columns(spark.sql(LINES_SQL).columns)
    names = label_names(list(query_labels), {"env": "test"})
    found = run.samples.select(F.explode(F.map_keys("labels")).alias("label"))
    counted = found.groupBy("label").agg(F.count("*").alias("n"))
    # every name the definition promises must be there, and no other
    promised = spark.createDataFrame([(n,) for n in names], "name string")
    both = counted.join(promised, F.col("label") == F.col("name"), "full")
    return both.select(F.coalesce("label", "name").alias("label"), F.when(F.col("name").isNotNull(), F.col("n")).alias("n"))


@check(
    "a24_label_merge",
    o.counter("shop_seen", {**FLAG, "l_linestatus": "'any'", **ENV}, "lineitem"),
)
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global label replaces a query label of its name, so rows that differed only there are one series."""
    tables(spark, sf_dir, "lineitem")
    sql = "select l_returnflag, l_linestatus, l_tax as value from lineitem"
    return run_metrics(spark, {"counter": [{"name": "seen", "sql": sql}]}, {"l_linestatus": "any", "env": "test"})


@check(
    "a24_map_merge",
    o.rows({**FLAG, "l_linestatus": "'any'", **ENV}, "l_tax", "lineitem"),
)
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    rows = extract(spark.sql("select l_returnflag, l_linestatus, l_tax as value from lineitem"))
    other = F.create_map(F.lit("l_linestatus"), F.lit("any"), F.lit("env"), F.lit("test"))
    return rounded(rows.select(canonical_map(merge(F.col("labels"), other)).alias("labels"), "value"))


@check(
    "a25_config_labels",
    o.gauge(
        "core_lines",
        {**STATUS, "instance_name": "'ledger'", "region": "'eu'", "cell": "'c1'", "unset": "''"},
        "a",
        LINES_GROUP,
    ),
)
def config_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a config: its name, constants, and values from the environment."""
    tables(spark, sf_dir, "lineitem")
    os.environ["METRICSPARK_CHECK_REGION"] = "eu"
    config = Config.from_dict(
        {
            "name": "ledger",
            "globalLabels": [{"region": "$METRICSPARK_CHECK_REGION"}, {"cell": "c1"}, {"unset": "$METRICSPARK_UNSET"}],
            "metrics": {"gauge": LINES},
        }
    )
    return samples(run_config(spark, config))


PRICES = "select l_returnflag, l_extendedprice as v from lineitem"


@check(
    "a26_metadata",
    o.union(
        o.gauge("acme_shop_lines", {**STATUS, **ENV}, "a", LINES_GROUP),
        o.counter("acme_shop_seen", {**FLAG, **ENV}, "lineitem"),
        o.histogram("acme_shop_price", {**FLAG, **ENV}, "l_extendedprice", "lineitem", [1000, 50000]),
        o.summary("acme_shop_price_q", {**FLAG, **ENV}, "l_extendedprice", "lineitem", [0.5]),
    ),
)
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package name, prefix and global labels on all four kinds."""
    tables(spark, sf_dir, "lineitem")
    metrics = {
        "gauge": LINES,
        "counter": [{"name": "seen", "sql": PRICES}],
        "histogram": [{"name": "price", "sql": PRICES, "buckets": [1000, 50000]}],
        "summary": [{"name": "price_q", "sql": PRICES, "objectives": [0.5]}],
    }
    p = Package.from_dict({"name": "shop", "metrics": metrics}, prefix="acme_")
    return samples(run_package(spark, p, {"env": "test"}))


@check(
    "a27_definitions_merge",
    o.union(
        o.gauge("shop_lines", STATUS, "a", LINES_GROUP),
        o.gauge("shop_all_lines", {}, "a", "(select count(*) as a from lineitem) g"),
        o.counter("shop_seen", FLAG, "lineitem"),
    ),
)
def definitions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    first = [MetricDef("gauge", "lines", LINES_SQL)]
    second = [MetricDef("counter", "seen", PRICES), MetricDef("gauge", "all_lines", "select count(*) from lineitem")]
    return samples(run_package(spark, Package("shop", metrics=merge_metrics(first, second))))
