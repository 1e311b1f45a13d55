"""Exact quantiles of every series in two scans, without holding a series in one task.

The quantile q of n values is the value of rank ceil(q * n). The first scan counts each series and sketches
it; the sketch can be merged, and its rank error is bounded, so for every quantile it gives two values that
have the wanted rank between them. The second scan counts rows: one group per series for all that lies between
two such brackets, and one per value inside a bracket. Running counts over these groups find the rank exactly.

Both scans combine their counts in the map tasks, so one series may hold most of the table. What the second
one leaves of a series is a fixed small part of it. Where even that is too much for one task, it is written
to the shared folder, and counting passes over it narrow the brackets; the table itself is not read again.
A bracket that does not hold its rank raises an error, it never yields another value.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_DOWN, Decimal
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark.session import settle

# Rank error of the sketch, as a part of the rows; brackets reach three times as far to either side.
ACCURACY = 10_000
MARGIN = 3
# Most rows within brackets of one series that are ranked in one window group, which may spill.
RANK_ROWS = 1_000_000
# Ranges a pass divides each open range into.
RANGES = 4096
# Most open ranges sent to every task; more are joined by a shuffle.
BROADCAST_RANGES = 100_000
# In that shuffle a series with more than one in so many of the rows goes by several salts.
SALTED_SHARES = 10_000

LARGEST_DOUBLE = 1.7976931348623157e308


def _sides(
    rows: DataFrame, settled: DataFrame, keys: Sequence[str], value: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and a settled frame with the `series_n` of its keys, made ready to be joined by the names returned.

    The settled side is broadcast when its count says it is small. Otherwise both are shuffled, and a series
    that holds more than its share of the rows is dealt over as many salts as it has shares. Fewer than
    SALTED_SHARES series can, so these are sent to every task, and the settled side grows by as few copies.
    """
    if settled.count() <= BROADCAST_RANGES:
        return rows, F.broadcast(settled.drop("series_n")), list(keys)
    series = settled.select(*keys, "series_n").distinct()
    share = series.agg(F.sum("series_n")).first()[0] / SALTED_SHARES
    salts = F.ceil(F.col("series_n") / share).cast("int")
    uneven, same = _renamed(series.where(salts > 1).select(*keys, salts.alias("salts")), keys)
    # the task counts too, so that one value that fills a series is dealt out as well
    salt = F.coalesce(F.pmod(F.xxhash64(value, F.spark_partition_id()), F.col("salts")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(uneven), reduce(and_, same), "left").select(*rows.columns, salt.alias("salt"))
    copies = settled.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("series_n")
    return dealt, copies, [*keys, "salt"]


def _match(left: DataFrame, right: DataFrame, names: Sequence[str], *conds: Column) -> DataFrame:
    """Inner join on `names`, where NULL equals NULL; the names are kept once."""
    right, same = _renamed(right, names)
    return left.join(right, reduce(and_, [*same, *conds])).drop(*[f"other_{k}" for k in names])


def _except(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose `names` are not in `right`, where NULL equals NULL."""
    right, same = _renamed(right, names)
    return left.join(right, reduce(and_, same), "left_anti")


def _renamed(right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    right = right.select(*[F.col(k).alias(f"other_{k}") if k in names else F.col(k) for k in right.columns])
    return right, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in names]


def _rank(q: float) -> str:
    """SQL of ceil(q * n) in decimal arithmetic, for the shortest decimal that reads as q: 0.07 of 100
    rows is the 7th row, and 2/3 of 30,000 the 20,000th. Series of every size go by it."""
    if q >= 1:
        return "n"
    text = f"{Decimal(repr(float(q))).quantize(Decimal('1e-18'), ROUND_DOWN):f}"
    return f"greatest(1L, cast(ceil(cast('{text}' as decimal(18,18)) * cast(n as decimal(19,0))) as bigint))"


def _root(x: Column) -> Column:
    """The 1024th root with the sign kept, which spreads magnitudes as evenly as a logarithm does.

    It is made of square roots, as these are correctly rounded and so never change an order.
    """
    root = F.abs(x)
    for _ in range(10):
        root = F.sqrt(root)
    return F.signum(x) * root


def _range_number(v: Column, lo: Column, hi: Column, by_root: bool) -> Column:
    """The number of the range v falls in; a larger value never gets a smaller number."""
    scale = _root if by_root else (lambda x: x)
    first = scale(F.greatest(lo, F.lit(-LARGEST_DOUBLE)))
    last = scale(F.least(hi, F.lit(LARGEST_DOUBLE)))
    position = (scale(v) - first) / F.nullif(last - first, F.lit(0.0)) * RANGES
    return (
        F.when(F.isnan(v), RANGES + 1)
        .when(v == float("inf"), RANGES)
        .when(v == float("-inf"), -1)
        .otherwise(F.floor(F.least(position, F.lit(RANGES - 1.0))).cast("int"))
    )


def _within(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that fall into an open range of their series, with that range."""
    v = F.col(value)
    if not keys:
        # one series has at most one range per quantile: a filter that the scan can use
        found = [(F.lit(r["lo"]), F.lit(r["hi"])) for r in ranges.collect()]
        hits = [(v >= lo) & (v <= hi) for lo, hi in found]
        return rows.where(reduce(or_, hits, F.lit(False))).select(
            value,
            "rows_in",
            F.coalesce(*[F.when(hit, lo) for hit, (lo, _) in zip(hits, found)], F.lit(None)).cast("double").alias("lo"),
            F.coalesce(*[F.when(hit, hi) for hit, (_, hi) in zip(hits, found)], F.lit(None)).cast("double").alias("hi"),
        )
    left, right, names = _sides(rows, ranges, keys, value)
    return _match(left, right, names, v >= F.col("lo"), v <= F.col("hi"))


def _at_rank(targets: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join each target to the counted group of its range that holds its rank.

    `counted` has the rows of a group as `rows_in` and those up to its end as `rows_upto`.
    """
    r = F.col("r")
    reached = r <= F.col("rows_upto")
    not_before = r > F.col("rows_upto") - F.col("rows_in")
    return _match(targets, counted, [*keys, "lo", "hi"], reached, not_before)


def _narrow(rows: DataFrame, targets: DataFrame, keys: list[str], value: str, rank_rows: int) -> DataFrame:
    """Counting passes until no range that still holds several values holds more than rank_rows rows."""
    too_many = (F.col("lo") < F.col("hi")) & (F.col("n") > rank_rows)
    by_root = True
    while True:
        open_targets = targets.where(too_many)
        ranges = settle(open_targets.select(*keys, "lo", "hi", "series_n").distinct())
        if ranges.isEmpty():
            return targets
        number = _range_number(F.col(value), F.col("lo"), F.col("hi"), by_root)
        counted = (
            _within(rows, ranges, keys, value)
            .groupBy(*keys, "lo", "hi", number.alias("range"))
            .agg(F.sum("rows_in").alias("rows_in"), F.min(value).alias("new_lo"), F.max(value).alias("new_hi"))
        )
        up_to = Window.partitionBy(*keys, "lo", "hi").orderBy("range")
        counted = counted.withColumn("rows_upto", F.sum("rows_in").over(up_to))
        narrowed = _at_rank(open_targets, counted, keys).select(
            *keys,
            "series_n",
            "total",
            F.col("rows_in").alias("n"),
            F.col("new_lo").alias("lo"),
            F.col("new_hi").alias("hi"),
            "slot",
            (F.col("r") - F.col("rows_upto") + F.col("rows_in")).alias("r"),
        )
        targets = settle(targets.where(~too_many).unionByName(narrowed))
        # roots suit values of many magnitudes, even steps suit what is left of one magnitude
        by_root = not by_root


def _inner(qs: Sequence[float], accuracy: int) -> list[float]:
    reach = MARGIN / accuracy
    return sorted({x for q in qs for x in (q - reach, q + reach) if 0 < x < 1})


def bracket_aggregates(value: str, qs: Sequence[float], accuracy: int = ACCURACY) -> dict[str, str]:
    """What the first scan aggregates of a series, as SQL by name."""
    points = ", ".join(f"double('{x!r}')" for x in _inner(qs, accuracy))
    totals = {"series_n": "count(1)", "total": f"sum({value})", "least": f"min({value})", "greatest": f"max({value})"}
    return totals | ({"sketch": f"percentile_approx({value}, array({points}), {accuracy})"} if points else {})


def bracket_columns(qs: Sequence[float], accuracy: int = ACCURACY, tag: str = "") -> list[str]:
    """A series' count and total, and for each quantile two values that hold its rank between them, of the
    aggregates, whose names begin with `tag`."""
    inner, reach = _inner(qs, accuracy), MARGIN / accuracy

    def bound(x: float, beyond: str) -> str:
        return f"{tag}sketch[{inner.index(x)}]" if 0 < x < 1 else f"{tag}{beyond}"

    pairs = [(bound(q - reach, "least"), bound(q + reach, "greatest")) for q in qs]
    ends = [e for i, (lo, hi) in enumerate(pairs) for e in (f"{lo} as lo_{i}", f"{hi} as hi_{i}")]
    return [f"{tag}series_n as series_n", f"{tag}total as total", *ends]


def _counted(rows: DataFrame, brackets: DataFrame, keys: list[str], value: str, slots: int) -> DataFrame:
    """Rows, and the series' total, per series and `code`, which numbers in order of value the stretches that brackets
    cut a series into; within brackets also per value, as `answer`."""
    if keys:
        left, right, names = _sides(rows, brackets, keys, value)
        joined = _match(left, right, names)
    else:
        found = brackets.first()
        ends = [F.lit(found[f"{end}_{i}"]).alias(f"{end}_{i}") for i in range(slots) for end in ("lo", "hi")]
        joined = rows.select(value, F.lit(found["total"]).alias("total"), *ends)
    from_lo = reduce(add, [(F.col(value) >= F.col(f"lo_{i}")).cast("int") for i in range(slots)])
    past_hi = reduce(add, [(F.col(value) > F.col(f"hi_{i}")).cast("int") for i in range(slots)])
    return (
        joined.select(*keys, value, "total", from_lo.alias("from_lo"), past_hi.alias("past_hi"))
        .groupBy(
            *keys,
            (F.col("from_lo") + F.col("past_hi")).alias("code"),
            F.when(F.col("from_lo") > F.col("past_hi"), F.col(value)).alias("answer"),
        )
        .agg(F.count(F.lit(1)).alias("rows_in"), F.max("total").alias("total"))
    )


def _totals(keys: list[str]) -> list[Column]:
    """The rows of each series, and its total."""
    whole = Window.partitionBy(*keys)
    return [F.sum("rows_in").over(whole).alias("n"), F.max("total").over(whole).alias("total")]


def _found(columns: Sequence[Column]) -> list[Column]:
    """Answers, or an error where a bracket did not hold its rank."""
    missed = F.raise_error(F.lit("a sketch missed the rank of a quantile")).cast("double")
    return [F.coalesce(c, missed).alias(f"q_{i}") for i, c in enumerate(columns)]


def _rank_in_series(counted: DataFrame, keys: list[str], qs: Sequence[float]) -> DataFrame:
    """All quantiles from running counts over the groups of each series."""
    in_order = Window.partitionBy(*keys).orderBy("code", "answer")
    ranked = counted.select(*keys, "answer", "rows_in", F.sum("rows_in").over(in_order).alias("rows_upto"), *_totals(keys))
    holds = "{r} > rows_upto - rows_in and {r} <= rows_upto"
    answers = [F.max(F.expr(f"if({holds.format(r=_rank(q))}, answer, null)")).alias(f"q_{i}") for i, q in enumerate(qs)]
    series = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max("total").alias("total"), *answers).where("n > 0")
    return series.select(*keys, "n", "total", *_found([F.col(f"q_{i}") for i in range(len(qs))]))


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    rank_rows: int = RANK_ROWS,
    accuracy: int = ACCURACY,
    brackets: DataFrame | None = None,
) -> DataFrame:
    """One row per series: its keys, `n`, `total`, and `q_0`, `q_1`, ... for the given quantiles.

    Runs the first scan while it is built, and both with the narrowing passes if a series is very large.
    `brackets` are given if another aggregation over the rows has made them, and are kept in the shared folder.
    """
    keys = list(keys)
    rows = rows.select(*keys, value)
    if not qs:
        totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        return totals.where("n > 0")
    if brackets is None:
        series = rows.groupBy(*keys).agg(*[F.expr(a).alias(c) for c, a in bracket_aggregates(value, qs, accuracy).items()])
        brackets = settle(series.where("series_n > 0").selectExpr(*keys, *bracket_columns(qs, accuracy)))
    largest = brackets.agg(F.max("series_n")).first()[0]
    if largest is None:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("total", *(f"q_{i}" for i in range(len(qs))))]
        return brackets.select(*keys, F.col("series_n").alias("n"), *nothing)
    counted = _counted(rows, brackets, keys, value, len(qs))
    # a bracket holds the reach and the sketch's error to either side
    if largest * len(qs) * 2 * (MARGIN + 1) / accuracy <= rank_rows:
        return _rank_in_series(counted, keys, qs)
    return _rank_in_ranges(settle(counted), keys, qs, rank_rows)


def frequency_quantiles(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """The same from one evaluation of `rows`, for rows that are few beside what they are made of, like the groups
    of a query: the different values of each series with their counts, and running counts over these."""
    keys = list(keys)
    counted = rows.groupBy(*keys, F.col(value).alias("answer")).agg(
        F.count(F.lit(1)).alias("rows_in"), F.sum(value).alias("some")
    )
    total = F.sum("some").over(Window.partitionBy(*keys))
    return _rank_in_series(counted.select("*", F.lit(0).alias("code"), total.alias("total")), keys, qs)


def _rank_in_ranges(counted: DataFrame, keys: list[str], qs: Sequence[float], rank_rows: int) -> DataFrame:
    """Quantiles of series whose brackets still hold very many rows: narrow them first, then rank what is left."""
    by_code = Window.partitionBy(*keys).orderBy("code")
    codes = (
        counted.groupBy(*keys, "code")
        .agg(
            F.sum("rows_in").alias("rows_in"),
            F.max("total").alias("total"),
            F.min("answer").alias("lo"),
            F.max("answer").alias("hi"),
        )
        .select(*keys, "rows_in", "lo", "hi", F.sum("rows_in").over(by_code).alias("rows_upto"), *_totals(keys))
    )
    wanted = ", ".join(f"named_struct('slot', {i}, 'r', {_rank(q)})" for i, q in enumerate(qs))
    targets = (
        codes.select("*", F.expr(f"inline(array({wanted}))"))
        .where("r > rows_upto - rows_in and r <= rows_upto")
        .withColumn("r", F.expr("r - rows_upto + rows_in"))
        .select(*keys, F.col("n").alias("series_n"), "total", F.col("rows_in").alias("n"), "lo", "hi", "slot", "r")
    )
    rows = counted.where("answer is not null").select(*keys, "answer", "rows_in")
    targets = _narrow(rows, settle(targets), keys, "answer", rank_rows)

    # every open range now holds at most rank_rows rows, so ranking within it is bounded
    several = F.col("lo") < F.col("hi")
    ranges = settle(targets.where(several).select(*keys, "lo", "hi", "series_n").distinct())
    within = _within(rows, ranges, keys, "answer").groupBy(*keys, "lo", "hi", "answer").agg(F.sum("rows_in").alias("rows_in"))
    by_value = Window.partitionBy(*keys, "lo", "hi").orderBy("answer")
    ranked = within.withColumn("rows_upto", F.sum("rows_in").over(by_value))
    found = _at_rank(targets.where(several), ranked, keys)
    # NaN sorts last and equals itself, so a range of NaN alone has lo = hi like any single value
    known = targets.where(~several | F.col("lo").isNull()).withColumn("answer", F.col("lo"))
    kept = [*keys, "series_n", "total", "slot", "answer"]
    per_slot = [F.max(F.when(F.col("slot") == i, F.col("answer"))).alias(f"q_{i}") for i in range(len(qs))]
    answers = known.select(*kept).unionByName(found.select(*kept))
    series = answers.groupBy(*keys).agg(F.max("series_n").alias("n"), F.max("total").alias("total"), *per_slot)
    return series.select(*keys, "n", "total", *_found([F.col(f"q_{i}") for i in range(len(qs))]))
