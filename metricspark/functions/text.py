"""Text to metrics: tokens, parsed log lines and full-text scores, over whole texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.session import settle

WORD = "[a-z]+"


def tokens(text: Column, pattern: str = WORD) -> Column:
    """The words of a text, lowered, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def token_counts(df: DataFrame, text: str, by: Sequence[str] = (), pattern: str = WORD) -> DataFrame:
    """How often each word occurs, per group: combined in the map tasks, spread by word after."""
    words = df.select(*by, F.explode(tokens(F.col(text), pattern)).alias("token"))
    return words.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def parse_lines(df: DataFrame, line: str, pattern: str, fields: Mapping[str, str]) -> DataFrame:
    """Log lines to typed columns, one per capture group, plus `parsed`.

    A line that does not match, or a field that is not of its type, leaves NULLs and the line
    counts as unparsed; no line is dropped.
    """
    text = F.col(line)
    typed = [
        F.regexp_extract(text, pattern, i + 1).try_cast(dtype).alias(name)
        for i, (name, dtype) in enumerate(fields.items())
    ]
    out = df.select("*", text.rlike(pattern).alias("matched"), *typed)
    complete = F.col("matched")
    for name in fields:
        complete = complete & F.col(name).isNotNull()
    typed_or_null = [F.when(complete, F.col(name)).alias(name) for name in fields]
    kept = [c for c in df.columns if c not in fields]
    return out.select(*kept, *typed_or_null, F.coalesce(complete, F.lit(False)).alias("parsed"))


def _occurrences(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, F.lit(term)))


def bm25(
    df: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75, pattern: str = WORD
) -> DataFrame:
    """BM25 score and number of matches of each text that holds a term: (key, matches, score).

    Term counts are taken within each row, so the texts are never exploded or shuffled. They are
    kept, a few numbers per text, as taking them is the cost here and the scores need the totals
    of all texts first. These are one row, read as a scalar subquery.
    """
    counts = [F.size("words").alias("words")]
    counts += [_occurrences(F.col("words"), t).alias(f"tf_{i}") for i, t in enumerate(terms)]
    # counted in a generator, so that the words of a text are extracted once for all counts
    words = df.select(key, tokens(F.col(text), pattern).alias("words"))
    per_text = settle(words.select(key, F.inline(F.array(F.struct(*counts)))))
    totals = per_text.agg(
        F.count(F.lit(1)).alias("texts"),
        F.avg("words").alias("mean_words"),
        *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))],
    )
    total = totals.select(F.struct("*").alias("total")).scalar()
    scored = per_text.where(F.greatest(*[F.col(f"tf_{i}") for i in range(len(terms))], F.lit(0)) > 0)
    scored = scored.withColumn("total", total)
    n, mean = F.col("total.texts"), F.col("total.mean_words")
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, with_term = F.col(f"tf_{i}"), F.col(f"total.df_{i}")
        idf = F.log(F.lit(1.0) + (n - with_term + 0.5) / (with_term + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("words") / mean))
    matches = sum((F.col(f"tf_{i}") for i in range(len(terms))), F.lit(0))
    return scored.select(key, matches.cast("long").alias("matches"), score.alias("score"))
