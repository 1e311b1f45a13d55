"""The four folds and package runs."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.checks import oracle as o
from metricspark.checks.harness import check, rounded, run_metrics, samples, tables
from metricspark.defs import DEFAULT_BUCKETS, Config, MetricDef, Package, SourceDef
from metricspark.operators.folds import SKETCH_ACCURACY, flat, fold_rows, summary_exact
from metricspark.operators.samples import to_rows
from metricspark.plans.package import run_package, run_packages

FLAG = {"flag": o.text("l_returnflag")}
PRICES = "select l_returnflag as flag, l_extendedprice as v from lineitem"
OBJECTIVES = [0.5, 0.9, 0.99, 0.5]


@check("a17_gauge", o.gauge("shop_price", FLAG, "l_extendedprice", "lineitem"))
def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows per label set: without an order the greatest value is kept."""
    tables(spark, sf_dir, "lineitem")
    return run_metrics(spark, {"gauge": [{"name": "price", "sql": PRICES}]})


@check(
    "a17_gauge_last",
    o.gauge(
        "shop_price",
        FLAG,
        "l_extendedprice",
        "lineitem l join (select l_returnflag as f, max(l_orderkey) as k from lineitem group by all) "
        "on l_returnflag = f and l_orderkey = k",
    ),
)
def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each label set by a declared order."""
    tables(spark, sf_dir, "lineitem")
    sql = "select l_returnflag as flag, l_orderkey as k, l_extendedprice as v from lineitem"
    return run_metrics(spark, {"gauge": [{"name": "price", "sql": sql, "orderBy": "k"}]})


@check("a18_counter", o.counter("shop_seen", FLAG, "lineitem"))
def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return run_metrics(spark, {"counter": [{"name": "seen", "sql": PRICES}]})


BUCKETS = [901.82, 1000, 2500.5, 50000, 104997.88]


@check(
    "a19_histogram",
    o.union(
        o.histogram("shop_price", FLAG, "l_extendedprice", "lineitem", BUCKETS),
        o.histogram("shop_tax", {}, "l_tax", "lineitem", DEFAULT_BUCKETS),
    ),
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that equal values of the table, and the default bounds."""
    tables(spark, sf_dir, "lineitem")
    return run_metrics(
        spark,
        {
            "histogram": [
                {"name": "price", "sql": PRICES, "buckets": BUCKETS},
                {"name": "tax", "sql": "select l_tax as value from lineitem"},
            ]
        },
    )


@check("a20_summary", o.summary("shop_price", FLAG, "l_extendedprice", "lineitem", OBJECTIVES))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return run_metrics(spark, {"summary": [{"name": "price", "sql": PRICES, "objectives": OBJECTIVES}]})


@check("a20_summary_large_series", o.summary("price", FLAG, "l_extendedprice", "lineitem", [0.001, 0.5, 0.99, 1]))
def summary_large_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets are wide and count as too large for one task, so counting passes narrow them first."""
    tables(spark, sf_dir, "lineitem")
    metric = MetricDef("summary", "price", PRICES, objectives=(0.001, 0.5, 0.99, 1))
    return rounded(flat(summary_exact(to_rows(spark.sql(PRICES)), metric, "price", rank_rows=500, accuracy=1000)))


THIRDS = (1 / 7, 1 / 3, 2 / 3)


@check(
    "a20_summary_any_objective",
    o.union(*[o.summary(n, FLAG, "l_extendedprice", "lineitem", THIRDS) for n in ("ranked", "narrowed")]),
)
def summary_any_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives without a short decimal, for series ranked from two scans and by counting passes."""
    tables(spark, sf_dir, "lineitem")
    rows = to_rows(spark.sql(PRICES))
    metrics = [MetricDef("summary", n, PRICES, objectives=THIRDS) for n in ("ranked", "narrowed")]
    ranked = summary_exact(rows, metrics[0], "ranked")
    narrowed = summary_exact(rows, metrics[1], "narrowed", rank_rows=500, accuracy=100)
    return rounded(flat(ranked.union(narrowed)))


@check("a20_summary_sketch")
def summary_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles within the sketch's rank error; the error is tested, equality is not promised."""
    tables(spark, sf_dir, "lineitem")
    sketch = {"name": "price", "sql": PRICES, "objectives": OBJECTIVES, "quantiles": "sketch"}
    return run_metrics(spark, {"summary": [sketch]})


def _error_oracle(objectives) -> str:
    qs = ", ".join(f"({q})" for q in sorted(set(objectives)))
    return (
        "select l_returnflag as flag, cast(q as double) as quantile, count(*) as n, true as within_error "
        f"from lineitem, (values {qs}) o(q) group by all"
    )


@check("a20_sketch_rank_error", _error_oracle(OBJECTIVES))
def sketch_rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sketched quantile lies within the promised part of its series' rows."""
    tables(spark, sf_dir, "lineitem")
    metric = MetricDef("summary", "price", PRICES, objectives=tuple(OBJECTIVES))
    sketch = fold_rows(to_rows(spark.sql(PRICES)), [(metric, "price")]).where("suffix = ''")
    found = sketch.select(
        F.col("labels")["flag"].alias("flag"),
        F.col("labels")["quantile"].cast("double").alias("quantile"),
        F.col("value").alias("found"),
    )
    ranks = spark.sql(PRICES).join(found, "flag").groupBy("flag", "quantile").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v") < F.col("found")).alias("below"),
        F.count_if(F.col("v") <= F.col("found")).alias("upto"),
    )
    allowed, target = F.col("n") / SKETCH_ACCURACY + 1, F.col("quantile") * F.col("n")
    within = (target >= F.col("below") - allowed) & (target <= F.col("upto") + allowed)
    return ranks.select("flag", "quantile", "n", within.alias("within_error"))


@check("a21_reset", o.union(o.counter("shop_seen", FLAG, "lineitem"), o.counter("shop_seen", FLAG, "lineitem")))
def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run starts from zero: counters do not add up over runs."""
    tables(spark, sf_dir, "lineitem")
    metrics = {"counter": [{"name": "seen", "sql": PRICES}]}
    return run_metrics(spark, metrics).unionByName(run_metrics(spark, metrics))


@check(
    "a29_shared_names",
    o.union(
        o.gauge("shop_lines", FLAG, "l_extendedprice", "lineitem"),
        o.counter("shop_seen", FLAG, "lineitem"),
        o.gauge("shop_tax", FLAG, "l_tax", "lineitem"),
    ),
)
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a full name in two kinds or two packages the first stays; the others are named, and the rest goes on."""
    tables(spark, sf_dir, "lineitem")
    taxes = "select l_returnflag as flag, l_tax as v from lineitem"
    first = {
        "gauge": [{"name": "lines", "sql": PRICES}],
        "counter": [{"name": "lines", "sql": PRICES}, {"name": "seen", "sql": PRICES}],
    }
    second = {"gauge": [{"name": n, "sql": taxes} for n in ("lines", "seen", "tax")]}
    run = run_packages(spark, [Package.from_dict({"name": "shop", "metrics": m}) for m in (first, second)])
    if len(run.errors) != 3:
        raise RuntimeError(str(run.errors))
    return rounded(flat(run.samples))


@check(
    "a28_registry",
    o.union(
        o.histogram("shop_price", FLAG, "l_extendedprice", "lineitem", [1000]),
        o.counter("shop_seen", FLAG, "lineitem"),
        o.gauge("shop_top", FLAG, "l_extendedprice", "lineitem"),
    ),
)
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that cannot be planned are left out and named; a repeated name means its last definition."""
    tables(spark, sf_dir, "lineitem")
    metrics = {
        "gauge": [
            {"name": "no_column", "sql": "select nothing from lineitem"},
            {"name": "top", "sql": "select l_returnflag as flag, l_tax as v from lineitem"},
            {"name": "top", "sql": PRICES},
        ],
        "counter": [{"name": "seen", "sql": PRICES}, {"name": "no_sql", "sql": "selec 1"}],
        "histogram": [
            {"name": "price", "sql": PRICES, "buckets": [1000]},
            {"name": "own_le", "sql": "select 'x' as le, l_tax as v from lineitem"},
        ],
    }
    run = run_package(spark, Package.from_dict({"name": "shop", "metrics": metrics}))
    if sorted(run.errors) != ["shop_no_column", "shop_no_sql", "shop_own_le"]:
        raise RuntimeError(str(run.errors))
    return rounded(run.table)


@check(
    "a29_packages_and_core",
    o.union(
        o.counter("a_one_seen", {**FLAG, "instance_name": "'ledger'"}, "lineitem"),
        o.counter("two_seen", {**FLAG, "instance_name": "'ledger'"}, "lineitem"),
        o.gauge(
            "core_orders",
            {"instance_name": "'ledger'", "status": o.text("o_orderstatus")},
            "a",
            "(select o_orderstatus, count(*) as a from orders group by all) g",
        ),
    ),
)
def packages_and_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two packages and the config's own definitions in one result; sources are shared by name."""
    seen = {"counter": [{"name": "seen", "sql": PRICES}]}
    lineitem = SourceDef("lineitem", "parquet", f"{sf_dir}/lineitem.parquet")
    first = Package("one", sources=(lineitem,), metrics=Package.from_dict({"name": "x", "metrics": seen}).metrics, prefix="a_")
    second = Package.from_dict({"name": "two", "metrics": seen})
    config = Config.from_dict(
        {
            "name": "ledger",
            "sources": [{"name": "orders", "type": "parquet", "source": f"{sf_dir}/orders.parquet"}],
            "metrics": {
                "gauge": [
                    {"name": "orders", "sql": "from orders select o_orderstatus as status, count(*) as v group by all"}
                ]
            },
        }
    )
    return samples(run_packages(spark, [first, second, config.core_package()], config.labels()))


@check(
    "a30_macros",
    o.gauge(
        "shop_net",
        FLAG,
        "a",
        "(select l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * 1.5), 2) as a from lineitem group by all) g",
    ),
)
def macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros with typed and default parameters, a subquery as body, and a table result."""
    tables(spark, sf_dir, "lineitem", "region")
    sql = (
        "select flag, round(net * regions() / 5, 2) as v from "
        "(select flag, sum(net(price, discount)) as net from lines('Z') group by 1)"
    )
    return run_metrics(
        spark,
        {"gauge": [{"name": "net", "sql": sql}]},
        macros=[
            {"sql": "net(price double, discount double, rate double default 1.5) as (price * (1 - discount) * rate);"},
            {"name": "regions", "sql": "regions() return (select count(*) from region)"},
            {
                "sql": "lines(before string) as table select l_returnflag as flag, l_extendedprice as price, "
                "l_discount as discount from lineitem where l_returnflag < before"
            },
        ],
    )


PACKAGE_YAML = """
name: yaml-shop
version: '1.0'
sources:
  - name: big_lines
    source: select * from lineitem where l_quantity >= :min_quantity
metrics:
  counter:
    - name: big_lines
      help: Lines of at least the given quantity
      sql: select l_returnflag as flag from big_lines
"""


@check("a31_package_yaml", o.counter("yaml_shop_big_lines", FLAG, "(select * from lineitem where l_quantity >= 40) x"))
def package_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return samples(run_package(spark, Package.from_dict(yaml.safe_load(PACKAGE_YAML), {"min_quantity": 40})))


@check("a32_enabled", o.counter("shop_seen", FLAG, "lineitem"))
def enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    off = {"name": "off", "sql": PRICES, "enabled": False}
    return run_metrics(spark, {"counter": [{"name": "seen", "sql": PRICES, "enabled": True}, off]})
