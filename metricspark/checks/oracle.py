"""SQL twins: the same samples, written out as plain SQL for another engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from metricspark.checks.harness import DIGITS
from metricspark.functions.numbers import python_number_text


def labels(texts: Mapping[str, str]) -> str:
    """`a="x",b="y"` from label name to text expression."""
    if not texts:
        return "''"
    parts = [f"""'{k}="' || {texts[k]} || '"'""" for k in sorted(texts)]
    return " || ',' || ".join(parts)


def text(c: str) -> str:
    return f"coalesce(cast({c} as varchar), 'NULL')"


def _value(expr: str) -> str:
    return f"round(cast({expr} as double), {DIGITS})"


def rows(texts: Mapping[str, str], value: str, source: str) -> str:
    """Extracted rows: labels and value."""
    return f"select {labels(texts)} as labels, {_value(value)} as value from {source}"


def _folded(name: str, kind: str, texts: Mapping[str, str], value: str, source: str, lines: Sequence[tuple]) -> str:
    """Lines are (suffix, extra label, its value, aggregate over v)."""
    selects = []
    for suffix, extra, extra_value, agg in lines:
        series = "labels"
        if extra:
            comma = "," if texts else ""
            series = f"""labels || '{comma}{extra}="{extra_value}"'"""
        selects.append(
            f"select '{name}' as name, '{kind}' as kind, '{suffix}' as suffix, {series} as labels, "
            f"{_value(agg)} as value from samples group by samples.labels having count(*) > 0"
        )
    union = "\nunion all\n".join(selects)
    return f"""select * from (
with samples as materialized (select {labels(texts)} as labels, cast({value} as double) as v from {source})
{union}) folded"""


def gauge(name: str, texts: Mapping[str, str], value: str, source: str) -> str:
    return _folded(name, "gauge", texts, value, source, [("", None, None, "max(v)")])


def counter(name: str, texts: Mapping[str, str], source: str) -> str:
    return _folded(name, "counter", texts, "1", source, [("", None, None, "count(*)")])


TOTALS = [("_sum", None, None, "sum(v)"), ("_count", None, None, "count(*)")]


def histogram(name: str, texts: Mapping[str, str], value: str, source: str, buckets: Sequence[float]) -> str:
    lines = [
        ("_bucket", "le", python_number_text(float(b)), f"count(*) filter (where v <= {b})") for b in buckets
    ]
    lines.append(("_bucket", "le", "+Inf", "count(*)"))
    return _folded(name, "histogram", texts, value, source, [*lines, *TOTALS])


def summary(name: str, texts: Mapping[str, str], value: str, source: str, objectives: Sequence[float]) -> str:
    lines = [
        ("", "quantile", python_number_text(float(q)), f"quantile_disc(v, {q})") for q in sorted(set(objectives))
    ]
    return _folded(name, "summary", texts, value, source, [*lines, *TOTALS])


def union(*queries: str) -> str:
    return "\nunion all\n".join(f"select * from ({q})" for q in queries)


def whole_number_text(c: str) -> str:
    """A whole number as shortest text, in exponent form from a million on."""
    digits = f"cast(cast({c} as hugeint) as varchar)"
    kept = f"rtrim({digits}, '0')"
    exponent = f"lpad(cast(length({digits}) - 1 as varchar), 2, '0')"
    mantissa = f"{kept}[1] || case when length({kept}) > 1 then '.' || {kept}[2:] else '' end"
    return f"case when {c} < 1000000 then {digits} else {mantissa} || 'e+' || {exponent} end"
