"""Enrichment, text and places ahead of the folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.checks import oracle as o
from metricspark.checks.harness import check, run_metrics, table, tables
from metricspark.functions.geo import EARTH_RADIUS_KM, distance_km, grid_cell, near
from metricspark.functions.macros import register_python_macro
from metricspark.functions.text import bm25, parse_lines, token_counts
from metricspark.operators.enrich import add_labels, classify, schematize
from metricspark.operators.rules import classify_many
from metricspark.operators.text_index import TextIndex
from metricspark.session import new_work_path

NATIONS = """(select coalesce(n_name, 'NULL') as nation, coalesce(c_mktsegment, 'NULL') as segment, o_totalprice as p
  from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey) j"""


@check(
    "c03_enrichment_join",
    o.union(
        o.counter("shop_orders", {"nation": "nation", "segment": "segment"}, NATIONS),
        o.gauge("shop_paid", {"nation": "nation"}, "a", f"(select nation, sum(p) as a from {NATIONS} group by all) g"),
    ),
)
def enrichment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from two dimension tables; orders without a match keep the label NULL."""
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    labelled = add_labels(orders, customer, ["o_custkey"], ["c_mktsegment", "c_nationkey"])
    add_labels(labelled, nation, ["c_nationkey"], ["n_name"]).createOrReplaceTempView("labelled_orders")
    return run_metrics(
        spark,
        {
            "counter": [{"name": "orders", "sql": "select n_name as nation, c_mktsegment as segment from labelled_orders"}],
            "gauge": [{"name": "paid", "sql": "select n_name as nation, sum(o_totalprice) as v from labelled_orders group by 1"}],
        },
    )


LOG_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\S*) (\w+) (\d+) (-?\d+\.\d+)$"


@check(
    "c04_log_lines",
    """select event_type,
      count(*) filter (where event_id % 100 <> 0) as parsed_lines,
      count(*) filter (where event_id % 100 = 0) as unparsed_lines,
      cast(coalesce(sum(user_id) filter (where event_id % 100 <> 0), 0) as bigint) as users,
      round(coalesce(sum(value) filter (where event_id % 100 <> 0), 0), 4) as value
    from events group by event_type""",
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log, some of them damaged, to typed columns; unparsed lines are counted."""
    line = F.concat_ws(
        " ", F.col("ts").cast("string"), "event_type", F.col("user_id").cast("string"), F.col("value").cast("string")
    )
    damaged = F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("!"), line)).otherwise(line)
    lines = table(spark, sf_dir, "events").select("event_type", damaged.alias("line"))
    fields = {"at": "timestamp_ntz", "kind": "string", "user_id": "bigint", "value": "double"}
    parsed = parse_lines(lines, "line", LOG_PATTERN, fields)
    return parsed.groupBy("event_type").agg(
        F.count_if("parsed").alias("parsed_lines"),
        F.count_if(~F.col("parsed")).alias("unparsed_lines"),
        F.coalesce(F.sum("user_id"), F.lit(0)).alias("users"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("value"),
    )


@check(
    "c05_schematize",
    o.counter("shop_ks", {"k": o.text("props->>'k'")}, "events"),
)
def schematized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column without a known schema becomes typed columns."""
    schematize(table(spark, sf_dir, "events"), "props").createOrReplaceTempView("schematized")
    return run_metrics(spark, {"counter": [{"name": "ks", "sql": "select k from schematized"}]})


@check(
    "c06_tokens",
    "select lang, token, count(*) as n from "
    "(select lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) group by all",
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "text", ["lang"])


@check(
    "c06_letters",
    "select token, count(*) as n from "
    "(select unnest(regexp_extract_all(lower(text), '\\p{L}+')) as token from documents) group by all",
)
def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in any alphabet."""
    return token_counts(table(spark, sf_dir, "documents"), "text", pattern=r"\p{L}+")


RULES = [
    (r"^https?://m\.", "mobile"),
    (r"[?&]page=\d+", "listing"),
    (r"\.org(/|$)", "org"),
    (r"/(fr|de|es)/", "translated"),
]


@check(
    "c07_rules",
    o.counter(
        "shop_pages",
        {
            "class": "case "
            + " ".join(f"when regexp_matches(url, '{p}') then '{c}'" for p, c in RULES)
            + " else 'other' end"
        },
        "pages",
    ),
)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(classify(F.col("url"), RULES).alias("class"))
    pages.createOrReplaceTempView("classified_pages")
    return run_metrics(spark, {"counter": [{"name": "pages", "sql": "select class from classified_pages"}]})


MANY_RULES = [(rf"/{lang}/{n}\b", f"{lang} {n % 7}") for n in range(0, 1000, 2) for lang in ("en", "fr", "es", "de")]
MANY_RULES[100:100] = RULES


@check(
    "c07_many_rules",
    "with rules(rank, pattern, class) as (values "
    + ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(MANY_RULES))
    + """), firsts as (select page_id, min(rank) as rank from pages, rules where regexp_matches(url, pattern) group by 1)
    select p.page_id, coalesce(r.class, 'other') as class from pages p left join firsts f on p.page_id = f.page_id
    left join rules r on r.rank = f.rank""",
)
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand rules, each tried on the pages that hold what it needs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return classify_many(pages, "page_id", "url", MANY_RULES).select("page_id", "class")


TERMS = ("the", "and", "les")


def _bm25_oracle(best: int | None = None) -> str:
    tfs = ", ".join(f"len(list_filter(words, lambda x: x = '{t}')) as tf_{i}" for i, t in enumerate(TERMS))
    dfs = ", ".join(f"count(*) filter (where tf_{i} > 0) as df_{i}" for i in range(len(TERMS)))
    score = " + ".join(
        f"ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * dl / mean))"
        for i in range(len(TERMS))
    )
    matches = " + ".join(f"tf_{i}" for i in range(len(TERMS)))
    return f"""with d as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as words from documents),
      t as (select doc_id, len(words) as dl, {tfs} from d),
      c as (select count(*) as n, avg(dl) as mean, {dfs} from t)
      select doc_id, cast({matches} as bigint) as matches, round({score}, 4) as score from t, c where {matches} > 0
      {"" if best is None else f"order by {score} desc, doc_id limit {best}"}"""


@check("c08_bm25", _bm25_oracle())
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return found.withColumn("score", F.round("score", 4))


@check("c08_index", _bm25_oracle())
def index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from an index that was written once."""
    path = new_work_path(spark, "text-index")
    TextIndex.write(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    found = TextIndex.read(spark, path).search(TERMS)
    return found.select(F.col("key").alias("doc_id"), "matches", F.round("score", 4).alias("score"))


@check("c08_index_best", _bm25_oracle(10))
def index_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best texts, from the blocks whose bounds reach them."""
    path = new_work_path(spark, "text-index")
    index = TextIndex.write(table(spark, sf_dir, "documents"), "doc_id", "text", path, block_texts=64)
    found = index.search(TERMS, 10)
    return found.select(F.col("key").alias("doc_id"), "matches", F.round("score", 4).alias("score"))


LAT, LON = "(user_id * 37 % 17900) / 100.0 - 89", "(user_id * 91 % 35900) / 100.0 - 179"


@check(
    "c09_places",
    o.union(
        o.counter(
            "shop_cells",
            {"cell": "cast(cast(floor(lat / 5) as bigint) as varchar) || ':' || cast(cast(floor(lon / 5) as bigint) as varchar)"},
            f"(select cast({LAT} as double) as lat, cast({LON} as double) as lon from events) e",
        ),
        o.gauge(
            "shop_near",
            {"event_type": "event_type"},
            "a",
            f"""(select event_type, count(*) as a from (select event_type, cast({LAT} as double) as lat,
              cast({LON} as double) as lon from events)
              where {2 * EARTH_RADIUS_KM} * asin(sqrt(least(1.0, pow(sin(radians(48.85 - lat) / 2), 2)
                + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - lon) / 2), 2)))) <= 5000
              group by 1) g""",
        ),
    ),
)
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per grid cell and within a radius; the places are derived from the users."""
    lat, lon = F.col("lat"), F.col("lon")
    events = table(spark, sf_dir, "events").select(
        "event_type", F.expr(f"cast({LAT} as double)").alias("lat"), F.expr(f"cast({LON} as double)").alias("lon")
    )
    events.select(
        "event_type", grid_cell(lat, lon, 5.0).alias("cell"), distance_km(lat, lon, 48.85, 2.35).alias("km")
    ).createOrReplaceTempView("placed_events")
    near = "select event_type, count(*) as v from placed_events where km <= 5000 group by 1"
    return run_metrics(
        spark,
        {
            "counter": [{"name": "cells", "sql": "select cell from placed_events"}],
            "gauge": [{"name": "near", "sql": near}],
        },
    )


@check(
    "c10_python_macro",
    o.counter("shop_sizes", {"size": "case when l_quantity < 10 then 'small' when l_quantity < 40 then 'medium' else 'large' end"}, "lineitem"),
)
def python_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over whole columns, called from metric SQL by name."""

    def size_class(quantity: pd.Series) -> pd.Series:
        return pd.cut(quantity, [-float("inf"), 10, 40, float("inf")], right=False, labels=["small", "medium", "large"]).astype(str)

    tables(spark, sf_dir, "lineitem")
    register_python_macro(spark, "size_class", size_class, "string")
    return run_metrics(spark, {"counter": [{"name": "sizes", "sql": "select size_class(l_quantity) as size from lineitem"}]})


SUPPLIER_LAT, SUPPLIER_LON = "(s_suppkey * 53 % 17900) / 100.0 - 89", "(s_suppkey * 131 % 35900) / 100.0 - 179"


@check(
    "c09_near",
    f"""with points as (select user_id, cast({LAT} as double) as lat, cast({LON} as double) as lon from events),
      places as (select s_suppkey, cast({SUPPLIER_LAT} as double) as place_lat, cast({SUPPLIER_LON} as double) as place_lon from supplier),
      pairs as (select s_suppkey, user_id, {2 * EARTH_RADIUS_KM} * asin(sqrt(least(1.0, pow(sin(radians(place_lat - lat) / 2), 2)
        + cos(radians(lat)) * cos(radians(place_lat)) * pow(sin(radians(place_lon - lon) / 2), 2)))) as km from points, places)
      select s_suppkey, count(*) as n, count(distinct user_id) as users, round(min(km), 3) as nearest from pairs where km <= 700 group by 1""",
)
def near_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within 700 kilometres of each supplier, joined through grid cells.

    A place is that of a user or supplier key, so each key is one row with the number of its events or rows: a pair of
    keys meets once, and no task remembers users to count different ones.
    """
    points = table(spark, sf_dir, "events").selectExpr(
        "user_id", f"cast({LAT} as double) as lat", f"cast({LON} as double) as lon"
    )
    users = points.groupBy("user_id", "lat", "lon").agg(F.count(F.lit(1)).alias("events"))
    places = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", f"cast({SUPPLIER_LAT} as double) as place_lat", f"cast({SUPPLIER_LON} as double) as place_lon"
    )
    suppliers = places.groupBy("s_suppkey", "place_lat", "place_lon").agg(F.count(F.lit(1)).alias("rows"))
    return near(users, suppliers, 700).groupBy("s_suppkey").agg(
        F.sum(F.col("events") * F.col("rows")).alias("n"), F.count("user_id").alias("users"), F.round(F.min("km"), 3).alias("nearest")
    )
