"""Samples as Prometheus text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.functions.numbers import number_text

ORDER = ("name", "part", "base", "pos")


def render(samples: DataFrame) -> DataFrame:
    """Lines with the columns they are ordered by: metrics by name, HELP and TYPE before the series.

    Each series carries the header lines along and only equal lines are merged, so the samples are
    computed once, a metric without samples gets no header, and every different value is kept.
    """
    braces = F.when(F.col("series") == "", "").otherwise(F.concat(F.lit("{"), F.col("series"), F.lit("}")))
    help_text = F.replace(F.replace(F.col("help"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))

    def line(part: int, base: Column, pos: Column, *text: Column | str) -> Column:
        parts = [F.lit(t) if isinstance(t, str) else t for t in text]
        return F.struct(
            F.lit(part).alias("part"), base.alias("base"), pos.alias("pos"), F.concat(*parts).alias("line")
        )

    name, none, zero = F.col("name"), F.lit(""), F.lit(0)
    value = line(2, F.col("base"), F.col("pos"), name, F.col("suffix"), braces, " ", number_text(F.col("value")))
    heads = [
        line(0, none, zero, "# HELP ", name, " ", help_text),
        line(1, none, zero, "# TYPE ", name, " ", F.col("kind")),
    ]
    lines = F.when(F.col("pos") == 0, F.array(*heads, value)).otherwise(F.array(value))
    return samples.select("name", F.inline(lines)).select(*ORDER, "line").distinct()


def write_text(samples: DataFrame, path: str) -> None:
    """Write the lines in order; part files follow each other in name order."""
    render(samples).orderBy(*ORDER).select("line").write.mode("overwrite").text(path)
