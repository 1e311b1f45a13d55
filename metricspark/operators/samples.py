"""Query result to samples: which column is the value, which are labels, and how both are read.

A column is the value if it is named `value`, `val` or `v`, or if its name holds both
parentheses, as an unaliased function call does. The last such column wins; with none the
value is 0. Every other column is a label.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricspark.functions.numbers import number_text, text_to_double
from metricspark.operators.labels import check_label_name

# The names of value columns, and the text of a NULL label.
VALUE_NAMES = ("value", "val", "v")
NULL_LABEL = "NULL"

VALUE = "sample_value"
ORDER = "sample_order"


def is_value_column(name: str) -> bool:
    return name in VALUE_NAMES or ("(" in name and ")" in name)


def split_columns(columns: Iterable[str], order_by: str | None = None) -> tuple[dict[str, int], int | None]:
    """Label names with their column positions, and the position of the value column."""
    labels: dict[str, int] = {}
    value = None
    for i, name in enumerate(columns):
        if is_value_column(name):
            value = i
        elif name != order_by:
            labels[name] = i
    return labels, value


def to_value(c: Column, dtype: T.DataType) -> Column:
    """A column as a metric value: NULL, and anything that is not a number, is 0."""
    zero = F.lit(0.0)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.cast("int").cast("double"), zero)
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c.cast("double"), zero)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return F.coalesce(text_to_double(c), zero)
    return zero


def _nested_text(c: Column, dtype: T.DataType) -> Column:
    return F.coalesce(label_text(c, dtype), F.lit("<nil>"))


def label_text(c: Column, dtype: T.DataType) -> Column:
    """A column as label text; NULL stays NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(c, single=isinstance(dtype, T.FloatType))
    if isinstance(dtype, T.TimestampNTZType):
        return F.concat(c.cast("string"), F.lit(" +0000 UTC"))
    if isinstance(dtype, T.TimestampType):
        return F.concat(F.to_utc_timestamp(c, F.current_timezone()).cast("string"), F.lit(" +0000 UTC"))
    if isinstance(dtype, T.DateType):
        return F.concat(c.cast("string"), F.lit(" 00:00:00 +0000 UTC"))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: _nested_text(x, dtype.elementType))
        return F.concat(F.lit("["), F.array_join(items, " "), F.lit("]"))
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        items = [F.concat(F.lit(f"{f.name}:"), _nested_text(c[f.name], f.dataType)) for f in fields]
        return F.when(c.isNotNull(), F.concat(F.lit("map["), F.concat_ws(" ", *items), F.lit("]")))
    if isinstance(dtype, T.MapType):
        items = F.array_sort(
            F.transform(
                F.map_entries(c),
                lambda e: F.concat(
                    _nested_text(e["key"], dtype.keyType), F.lit(":"), _nested_text(e["value"], dtype.valueType)
                ),
            )
        )
        return F.concat(F.lit("map["), F.array_join(items, " "), F.lit("]"))
    return c.cast("string")


def _groups_as_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.BinaryType, T.VariantType))


@dataclass(frozen=True)
class Rows:
    """Samples before folding.

    `frame` has one group key column per label, typed as in the query where equal values mean
    equal texts, plus the value (and the order column of a gauge). `texts` turns each key into
    its label text; it is applied after the aggregation, once per series instead of per row.
    `grouped` says that the rows are the groups of a query, few beside the rows these are made of.
    """

    frame: DataFrame
    labels: tuple[str, ...]
    texts: tuple[Column, ...]
    grouped: bool = False

    @property
    def keys(self) -> list[str]:
        return [f"key_{i}" for i in range(len(self.labels))]


def group_key(c: Column, dtype: T.DataType, name: str) -> tuple[Column, Column]:
    """What rows are grouped by for a label, as the column `name`, and the label's text of that column."""
    key = F.col(name)
    if isinstance(dtype, T.StringType):
        # NULL and the text NULL are one series
        return F.coalesce(c, F.lit(NULL_LABEL)), key
    if _groups_as_text(dtype):
        return F.coalesce(label_text(c, dtype), F.lit(NULL_LABEL)), key
    return c, F.coalesce(label_text(key, dtype), F.lit(NULL_LABEL))


# What may stand between a query's result and the grouping it comes from.
_SAME_ROWS = {"Project", "Filter", "SubqueryAlias", "View", "Sort", "GlobalLimit", "LocalLimit"}


def is_grouped(df: DataFrame) -> bool:
    """Whether the rows of a query are groups."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _SAME_ROWS:
        plan = plan.children().head()
    return plan.nodeName() == "Aggregate"


def to_rows(df: DataFrame, order_by: str | None = None, overridden: Mapping[str, str] | None = None) -> Rows:
    """Read a query result as samples. Labels named in `overridden` are replaced later, so they do not group."""
    labels, value = split_columns(df.columns, order_by)
    labels = {k: i for k, i in labels.items() if k not in (overridden or {})}
    for name in labels:
        check_label_name(name)
    types = [f.dataType for f in df.schema.fields]
    # positions instead of names: a query may repeat a column name
    cols = [f"c{i}" for i in range(len(types))]
    by_position = df.toDF(*cols)

    keys, texts = [], []
    for k, i in enumerate(labels.values()):
        key, text = group_key(F.col(cols[i]), types[i], f"key_{k}")
        keys.append(key)
        texts.append(text)
    out = [c.alias(f"key_{k}") for k, c in enumerate(keys)]
    out.append((F.lit(0.0) if value is None else to_value(F.col(cols[value]), types[value])).alias(VALUE))
    if order_by is not None:
        if order_by not in df.columns:
            raise ValueError(f"order column {order_by!r} is not a column of the query")
        out.append(F.col(cols[df.columns.index(order_by)]).alias(ORDER))
    return Rows(by_position.select(*out), tuple(labels), tuple(texts), is_grouped(df))


def extract(df: DataFrame) -> DataFrame:
    """Each row of a query as (labels map, value); lazy, nothing is collected."""
    rows = to_rows(df)
    pairs = [x for name, text in zip(rows.labels, rows.texts) for x in (F.lit(name), text)]
    labels = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.frame.select(labels.alias("labels"), F.col(VALUE).alias("value"))
