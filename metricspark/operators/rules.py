"""Many rules over texts: the first that matches, tried only where a text holds what the rule needs.

Most patterns need some literal characters in a row. Three of them index the rule: a text's different runs of three
characters are joined with the rules by these, the literal is looked for in the texts that have them, and only what is
left runs the pattern. Rules that need no literal are tried on every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def needed_literal(pattern: str) -> str:
    """The longest run of characters that every match of a pattern holds, as far as a look at it from left to right
    tells; empty if there is none, or if the pattern has alternatives, flags or quoting outside its groups."""
    if "(?" in pattern.replace("(?:", "").replace("(?<", "(") or "\\Q" in pattern:
        return ""
    best, run, depth, i = "", "", 0, 0

    def ended(last: str) -> str:
        return max(best, last, key=len)

    while i < len(pattern):
        c = pattern[i]
        literal, step = None, 1
        if c == "\\" and i + 1 < len(pattern):
            step = 2
            literal = pattern[i + 1] if not pattern[i + 1].isalnum() else None
        elif c == "[":
            # a class is some character: skip it, with a bracket or an escape inside
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            j += pattern[j : j + 1] == "]"
            inner = 1
            while j < len(pattern) and inner:
                inner += (pattern[j] == "[") - (pattern[j] == "]")
                j += 2 if pattern[j] == "\\" else 1
            step = j - i
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|":
            if depth == 0:
                return ""
        elif c not in ".^$*+?{}":
            literal = c
        following = pattern[i + step : i + step + 1]
        if literal is None or depth:
            best, run = ended(run), ""
        elif following and following in "*?{":
            best, run = ended(run), ""
        else:
            run += literal
            if following == "+":
                best, run = ended(run), ""
        # a repeat's bounds are no text
        i += step
        if pattern[i : i + 1] == "{":
            i = pattern.find("}", i) + 1 or len(pattern)
    return ended(run)


def classify_many(
    df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]], default: str = "other", column: str = "class"
) -> DataFrame:
    """`df` with the class of the first rule (pattern, class) that matches its text, as a further column.

    `key` tells rows apart whose texts differ. Null texts match nothing. What is shuffled is a row per text and rule that
    share three characters, and the texts that have such rules.
    """
    literals = [needed_literal(p) for p, _ in rules]
    used = Counter(g for x in literals for g in {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)})
    indexed, rest = [], []
    for rank, ((pattern, _), literal) in enumerate(zip(rules, literals)):
        grams = [literal[i : i + GRAM] for i in range(len(literal) - GRAM + 1)]
        if grams:
            # the run that the fewest rules share
            indexed.append((rank, pattern, literal, min(grams, key=lambda g: (used[g], g))))
        else:
            rest.append((rank, pattern))
    spark = df.sparkSession
    table = spark.createDataFrame(indexed, "rank int, pattern string, literal string, gram string")
    texts = df.select(F.col(key).alias("rule_key"), F.col(text).cast("string").alias("rule_text")).where("rule_text is not null")
    texts = texts.withColumn("rule_hash", F.xxhash64("rule_text")).dropDuplicates(["rule_key", "rule_hash"])
    starts = F.sequence(F.lit(1), F.length("rule_text") - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("rule_text"), i, F.lit(GRAM))))
    held = texts.where(F.length("rule_text") >= GRAM).select("rule_key", "rule_hash", F.explode(grams).alias("gram"))
    candidates = held.join(table.select("rank", "gram"), "gram").select(
        F.col("rule_key").alias("found_key"), F.col("rule_hash").alias("found_hash"), "rank"
    )
    same = texts["rule_key"].eqNullSafe(candidates["found_key"]) & (texts["rule_hash"] == candidates["found_hash"])
    tried = texts.join(candidates, same).join(table.drop("gram"), "rank")
    matched = tried.where(F.contains("rule_text", "literal") & F.expr("rule_text rlike pattern"))
    first = matched.groupBy("rule_key", "rule_hash").agg(F.min("rank").alias("rule_rank"))
    out = df.withColumn("rule_text", F.col(text).cast("string")).withColumn("rule_hash", F.xxhash64("rule_text"))
    first = first.select(F.col("rule_key").alias("found_key"), F.col("rule_hash").alias("found_hash"), "rule_rank")
    out = out.join(first, out[key].eqNullSafe(first["found_key"]) & (out["rule_hash"] == first["found_hash"]), "left")
    always = F.coalesce(*[F.when(F.col("rule_text").rlike(p), F.lit(rank)) for rank, p in rest], F.lit(None).cast("int"))
    classes = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(rules)], f"rule_first int, `{column}` string")
    ranked = out.withColumn("rule_first", F.least("rule_rank", always)).drop("rule_rank", "found_key", "found_hash", "rule_text", "rule_hash")
    named = ranked.drop(column).join(classes, "rule_first", "left").drop("rule_first")
    return named.withColumn(column, F.coalesce(column, F.lit(default)))
