"""Metric names, label merging and the canonical label text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a label may be called.
LABEL_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def check_label_name(name: str) -> None:
    if not LABEL_NAME.match(name):
        raise ValueError(f"{name!r} cannot be a label name; give the column an alias")


def full_name(prefix: str, package: str, name: str) -> str:
    return f"{prefix}{package.replace('-', '_')}_{name}"


def label_names(query_labels: Sequence[str], global_labels: Mapping[str, str]) -> list[str]:
    return [k for k in query_labels if k not in global_labels] + list(global_labels)


def merge(labels: Column, other: Column) -> Column:
    """Two label maps as one; where both have a key, `other` wins."""
    kept = F.map_filter(labels, lambda k, _: ~F.map_contains_key(other, k))
    return F.map_concat(kept, other)


def escape(text: Column) -> Column:
    """Backslash, quote and line feed as written inside a quoted label value."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def canonical(texts: Mapping[str, Column]) -> Column:
    """`a="x",b="y"`, sorted by label name. The names are known up front, so this is one concat."""
    if not texts:
        return F.lit("")
    pairs = [F.concat(F.lit(f'{k}="'), escape(texts[k]), F.lit('"')) for k in sorted(texts)]
    return F.concat_ws(",", *pairs)


def canonical_map(labels: Column) -> Column:
    """The canonical text of a label map whose names differ from row to row."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')),
    )
    return F.array_join(pairs, ",")
