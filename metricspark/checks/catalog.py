"""The shipped metrics, one check each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from metricspark import catalog
from metricspark.checks import oracle as o
from metricspark.checks.harness import check, samples, tables
from metricspark.plans.package import run_package, run_packages

INPUTS = {
    "activity": ("region", "customer", "supplier", "conversations", "events"),
    "deliveries": ("lineitem",),
    "sales": ("orders", "customer"),
}
ALL_INPUTS = tuple(dict.fromkeys(t for ts in INPUTS.values() for t in ts))

TURNS = "(select conv_id, turn, role, length(text) as chars from conversations) t"
ACTIONS = """(select user_id, value as amount, case when event_id % 40 = 7 then null else event_type end as kind,
  ts as done, props->>'k' as no from events) a"""
DELIVERED = "(select l_suppkey, l_extendedprice * (1 - l_discount) as net from lineitem) d"
ORDERED = """(select c_mktsegment as segment, o_orderpriority as priority, o_orderstatus as state,
  year(o_orderdate) as ordered_in, o_totalprice / 100 as price, c_acctbal as balance
  from orders left join customer on c_custkey = o_custkey) o"""

OF_TURNS = (0.25, 0.75, 0.95)
OF_MINUTES = (0.5, 0.9, 0.99, 0.999)
SPREAD = (0.002, 0.02, 0.1, 0.5, 0.95, 0.995)
BUCKETS = (20, 50, 100, 250, 500, 750, 1000, 1500, 2000, 2500, 3000, 3500, 4000, 4500, 4750, 4900, 4950, 4990)

ROLE = {"role": o.text("role")}
SUPPLIER = {"supplier": o.text("l_suppkey")}
SEGMENT = {"segment": o.text("segment")}
ORDER = {**SEGMENT, "priority": o.text("priority")}
# an object as label text, where quotes are escaped
ITEM = """coalesce('{\\"no\\":' || no || '}', 'NULL')"""
# who keeps a thing, and its number
THING = "'user/' || user_id || '/' || no"


def _grouped(columns: str, agg: str, source: str, where: str = "true") -> str:
    return f"(select {columns}, {agg} as a from {source} where {where} group by all) g"


def _total(agg: str, source: str, where: str = "true") -> str:
    return f"(select {agg} as a from {source} where {where}) g"


def _activity(name: str, labels: dict, source: str) -> tuple[str, str, str]:
    return "activity", name, o.gauge(f"activity_{name}", labels, "a", source)


def _per_minute(name: str, agg: str, kind: str) -> tuple[str, str, str]:
    group = _grouped("date_trunc('minute', done) as t", agg, ACTIONS, f"kind = '{kind}'")
    return "activity", name, o.summary(f"activity_{name}", {}, "a", group, OF_MINUTES)


def _top(kind: str, label: str) -> str:
    counts = f"select {label} as l, count(*) as a from {ACTIONS} where kind = '{kind}' and {label} is not null group by l"
    return f"({counts} order by a desc, l limit 10) g"


def _sales(name: str, labels: dict, columns: str, agg: str) -> tuple[str, str, str]:
    return "sales", name, o.gauge(f"sales_{name}", labels, "a", _grouped(columns, agg, ORDERED))


# package, metric, its SQL twin
METRICS = [
    _activity("regions", {}, _total("count(*)", "region")),
    _activity("customers", {}, _total("count(*)", "customer")),
    _activity("suppliers", {}, _total("count(*)", "supplier")),
    _activity("turns", {}, _total("count(*)", "conversations")),
    _activity("text_chars", {}, _total("sum(chars)", TURNS)),
    _activity("long_texts", {}, _total("count(*)", TURNS, "chars >= 300")),
    _activity("first_turns", {}, _total("count(*)", TURNS, "turn = 0")),
    _activity("answer_chars", {}, _total("coalesce(sum(chars) filter (role = 'assistant'), 0)", TURNS)),
    _activity("turns_by_role", ROLE, _grouped("role", "count(turn)", TURNS)),
    _activity("longest_by_role", ROLE, _grouped("role", "max(chars)", TURNS)),
    _activity("actions", {}, _total("count(amount)", ACTIONS)),
    _activity("actions_by_kind", {"kind": "coalesce(kind, 'not told')"}, _grouped("kind", "count(amount)", ACTIONS)),
    _activity("most_clicked", {"user": o.text("l")}, _top("click", "user_id::varchar")),
    _activity("most_bought", {"thing": o.text("l")}, _top("purchase", THING)),
    _activity("large_signups", {}, _total("count(*)", ACTIONS, "kind = 'signup' and amount >= 10")),
    ("activity", "chars_by_role", o.summary("activity_chars_by_role", ROLE, "chars", TURNS, OF_TURNS)),
    ("activity", "turn_by_role", o.summary("activity_turn_by_role", ROLE, "turn", TURNS, OF_TURNS)),
    _per_minute("signups_a_minute", "count(*)", "signup"),
    _per_minute("errors_a_minute", "count(*)", "error"),
    _per_minute("spent_a_minute", "sum(amount)", "purchase"),
    _per_minute("clickers_a_minute", "count(distinct user_id)", "click"),
    _per_minute("views_a_minute", "count(*)", "view"),
    (
        "deliveries",
        "net_by_supplier",
        o.gauge("deliveries_net_by_supplier", SUPPLIER, "a", _grouped("l_suppkey", "sum(net)", DELIVERED)),
    ),
    (
        "deliveries",
        "line_net_by_supplier",
        o.summary("deliveries_line_net_by_supplier", SUPPLIER, "net", DELIVERED, SPREAD),
    ),
    _sales(
        "orders_by_state", {**ORDER, "state": o.text("state")}, "segment, priority, lower(state) as state", "count(*)"
    ),
    _sales("orders", ORDER, "segment, priority", "count(*)"),
    _sales("mean_price", ORDER, "segment, priority", "avg(price)"),
    _sales("orders_by_year", {**SEGMENT, "year": o.text("ordered_in")}, "segment, ordered_in", "count(*)"),
    _sales("dearest", ORDER, "segment, priority", "max(price)"),
    _sales("mean_balance", ORDER, "segment, priority", "avg(balance)"),
    ("sales", "price", o.histogram("sales_price", ORDER, "price", ORDERED, BUCKETS)),
    ("sales", "price_quantiles", o.summary("sales_price_quantiles", ORDER, "price", ORDERED, SPREAD)),
    ("sales", "orders_seen", o.counter("sales_orders_seen", ORDER, ORDERED)),
]


def _one_metric(package: str, metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir, *INPUTS[package])
        p = catalog.load(package, materialize=False)
        return samples(run_package(spark, replace(p, metrics=tuple(m for m in p.metrics if m.name == metric))))

    return query


for _i, (_package, _metric, _sql) in enumerate(METRICS, 1):
    check(f"m{_i:02d}_{_metric}", _sql)(_one_metric(_package, _metric))


@check("m_all_packages", o.union(*[sql for _, _, sql in METRICS]))
def all_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packages in one run, each source computed once as a snapshot."""
    from metricspark.sources.register import forget_snapshots

    forget_snapshots(spark)
    tables(spark, sf_dir, *ALL_INPUTS)
    return samples(run_packages(spark, [catalog.load(n) for n in catalog.NAMES]))
