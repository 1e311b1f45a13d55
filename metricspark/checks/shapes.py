"""The query shapes that metric definitions use, as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricspark import catalog
from metricspark.checks import oracle as o
from metricspark.checks.catalog import ACTIONS, DELIVERED, INPUTS, ITEM, ORDERED, ROLE, SEGMENT, SUPPLIER, TURNS
from metricspark.checks.harness import check, extracted, run_metrics, tables
from metricspark.functions.macros import register_macros
from metricspark.sources import register_sources


def _views(spark: SparkSession, sf_dir: str) -> None:
    for name, inputs in INPUTS.items():
        tables(spark, sf_dir, *inputs)
        package = catalog.load(name, materialize=False)
        register_macros(spark, package.macros)
        register_sources(spark, package.sources)


def shape(name: str, sql: str, oracle: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir)
        return extracted(spark.sql(sql))

    check(name, oracle)(query)


KIND = {"kind": o.text("kind")}


def _by(column: str, agg: str, source: str, where: str = "true") -> str:
    return f"(select {column}, {agg} as a from {source} where {where} group by all) g"


shape("b01_alias", "select l_suppkey as supplier, net as value from delivered", o.rows(SUPPLIER, "net", DELIVERED))
shape("b02_literal", "select segment, 1 as value from ordered", o.rows(SEGMENT, "1", ORDERED))
shape(
    "b03_star",
    "select * from (select l_suppkey, net as v from delivered)",
    o.rows({"l_suppkey": o.text("l_suppkey")}, "net", DELIVERED),
)
shape("b04_struct_field", "select said.role, said.chars as val from turns", o.rows(ROLE, "chars", TURNS))
shape(
    "b05_struct_star",
    "select part.* from (select named_struct('role', said.role, 'v', turn) as part from turns)",
    o.rows(ROLE, "turn", TURNS),
)
shape(
    "b06_unnest",
    "select part.role, part.v from (select explode(array(named_struct('role', said.role, 'v', turn), "
    "named_struct('role', said.role, 'v', cast(said.chars as bigint)))) as part from turns)",
    o.rows(ROLE, "if(extra = 0, turn, chars)", f"{TURNS}, (values (0), (1)) e(extra)"),
)
shape(
    "b07_derived_table",
    "select role, v from (select role, chars + turn as v from (select said.role as role, said.chars as chars, turn from turns))",
    o.rows(ROLE, "chars + turn", TURNS),
)
shape(
    "b08_filter",
    "select kind, 1 as v from actions where kind = 'click' and amount >= 10",
    o.rows(KIND, "1", f"{ACTIONS} where kind = 'click' and amount >= 10"),
)
shape(
    "b09_is_not_null",
    "select kind, amount as v from actions where kind is not null",
    o.rows(KIND, "amount", f"{ACTIONS} where kind is not null"),
)
shape(
    "b10_coalesce",
    "select coalesce(kind, 'not told') as kind, amount as v from actions",
    o.rows({"kind": "coalesce(kind, 'not told')"}, "amount", ACTIONS),
)
shape("b11_lower", "select lower(state) as state, price as v from ordered", o.rows({"state": "lower(state)"}, "price", ORDERED))
shape(
    "b12_json_extract",
    "select get_json_object(details, '$.item') as item, 1 as v from actions",
    o.rows({"item": ITEM}, "1", ACTIONS),
)
shape(
    "b13_json_chain",
    "select try_variant_get(parse_json(details), '$.item.no', 'string') as no, amount as v from actions",
    o.rows({"no": o.text("no")}, "amount", ACTIONS),
)
shape(
    "b14_alias_in_filter",
    "select item, count(*) from (select *, get_json_object(details, '$.item.no') as item from actions) "
    "where item is not null group by 1",
    o.rows({"item": "no"}, "a", _by("no", "count(*)", ACTIONS, "no is not null")),
)
shape("b15_global_count", "select count(*) from actions", o.rows({}, "a", "(select count(*) as a from events) g"))
shape(
    "b16_sum",
    "select l_suppkey as supplier, sum(net) as value from delivered group by all",
    o.rows(SUPPLIER, "a", _by("l_suppkey", "sum(net)", DELIVERED)),
)
shape(
    "b17_average",
    "select segment, avg(price) as value from ordered group by all",
    o.rows(SEGMENT, "a", _by("segment", "avg(price)", ORDERED)),
)
shape(
    "b18_grouped_count",
    "select said.role, count(*) from turns group by said.role",
    o.rows(ROLE, "a", _by("role", "count(*)", TURNS)),
)
shape(
    "b19_group_by_ordinal",
    "select kind, count(*) from actions group by 1",
    o.rows(KIND, "a", _by("kind", "count(*)", ACTIONS)),
)
shape(
    "b20_group_by_all",
    "select segment, state, count(*) as v from ordered group by all",
    o.rows({**SEGMENT, "state": o.text("state")}, "a", _by("segment, state", "count(*)", ORDERED)),
)
shape(
    "b21_order_by_ordinal",
    "select kind, count(*) from actions group by 1 order by 2 desc, 1 asc",
    o.rows(KIND, "a", _by("kind", "count(*)", ACTIONS)),
)
shape(
    "b22_top_k",
    "select get_json_object(details, '$.item.no') as no, count(*) from actions group by 1 order by 2 desc, 1 limit 10",
    o.rows(
        {"no": o.text("no")},
        "a",
        f"(select no, count(*) as a from {ACTIONS} group by 1 order by 2 desc, 1 nulls first limit 10) g",
    ),
)
shape(
    "b23_minute",
    "select date_trunc('minute', at) as minute, count(*) from actions group by 1",
    o.rows(
        {"minute": "strftime(minute, '%Y-%m-%d %H:%M:%S') || ' +0000 UTC'"},
        "a",
        _by("date_trunc('minute', done) as minute", "count(*)", ACTIONS),
    ),
)
shape(
    "b24_epoch_micros",
    "select timestamp_micros(unix_micros(at)) as at, unix_micros(at) % 1000 as v from actions",
    o.rows({"at": "cast(make_timestamp(us) as varchar) || ' +0000 UTC'"}, "us % 1000", "(select epoch_us(ts) as us from events) e"),
)
shape(
    "b26_from_first",
    "from ordered select segment, count(*) as val group by all",
    o.rows(SEGMENT, "a", _by("segment", "count(*)", ORDERED)),
)
shape(
    "b27_pipe",
    "from actions |> where amount >= 10 |> aggregate count(*) as v group by kind",
    o.rows(KIND, "a", _by("kind", "count(*)", ACTIONS, "amount >= 10")),
)
shape(
    "b28_scalar_macro",
    "select segment, in_hundreds(balance) as value from ordered",
    o.rows(SEGMENT, "balance / 100", ORDERED),
)
shape("b29_identifier_case", "select SEGMENT as segment, Price as value from ORDERED", o.rows(SEGMENT, "price", ORDERED))

OBJECTIVES = [0.5, 0.9, 0.99, 0.999]


def _rate(unit: str) -> tuple[str, str]:
    sql = f"select date_trunc('{unit}', at), count(*) from actions group by 1"
    group = f"(select date_trunc('{unit}', ts) as t, count(*) as a from events group by all) g"
    return sql, o.summary("shop_rate", {}, "a", group, OBJECTIVES)


def _register_rate(unit: str) -> None:
    sql, oracle = _rate(unit)

    @check(f"b25_rate_per_{unit}", oracle)
    def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
        """An aggregate of an aggregate: both columns are functions, so the count is the value."""
        _views(spark, sf_dir)
        return run_metrics(
            spark, {"summary": [{"name": "rate", "sql": sql, "objectives": OBJECTIVES, "stage": True}]}
        )


for _unit in ("minute", "hour"):
    _register_rate(_unit)


BOUNDS = (1000, 10000, 50000)


@check(
    "b30_buckets_as_gauge",
    o.union(
        *[
            o.gauge(
                "shop_lines",
                {**SUPPLIER, "le": f"'{b}'"},
                "a",
                _by("l_suppkey", f"count(*) filter (where net <= {b})", DELIVERED),
            )
            for b in BOUNDS
        ]
    ),
)
def buckets_as_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram counted in SQL and shown as a gauge with a bound label."""
    _views(spark, sf_dir)
    counts = ", ".join(f"count_if(net <= {b}) as le_{b}" for b in BOUNDS)
    stack = ", ".join(f"'{b}', le_{b}" for b in BOUNDS)
    sql = (
        f"select supplier, stack({len(BOUNDS)}, {stack}) as (le, value) from "
        f"(select l_suppkey as supplier, {counts} from delivered group by 1)"
    )
    return run_metrics(spark, {"gauge": [{"name": "lines", "sql": sql}]})
