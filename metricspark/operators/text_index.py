"""An inverted index: full-text scores that read the postings of their terms only.

The index is written once. A row holds one term's postings among one block of texts: their keys, how often each holds the
term, and the greatest weight any of them gives it. Rows lie in folders by a hash of the term, sorted by term, so a query
reads few row groups of few folders; a term that most texts hold is spread over as many rows as there are blocks.

The best k texts are found in two steps. Weights alone tell a bound of every block's scores; the texts of the best
blocks are scored first, and then those of all blocks whose bound reaches the k-th of these scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.functions.text import WORD, tokens

K1, B = 1.2, 0.75
# Texts in a block on average, folders the terms are dealt over, and blocks that are scored first.
BLOCK_TEXTS = 4096
PARTS = 64
FIRST_BLOCKS = 4


def _run_starts(words: Column) -> Column:
    """Where each different word of sorted ones begins."""
    places = F.slice(F.sequence(F.lit(0), F.size(words)), F.lit(1), F.size(words))
    return F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))


def _runs(words: Column, starts: Column) -> Column:
    """(term, count) of each different word of sorted ones."""
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(words))
    return F.transform(starts, lambda s, i: F.struct(F.get(words, s).alias("term"), (end(i) - s).alias("count")))


@dataclass(frozen=True)
class TextIndex:
    """An index below a path; `texts` and `mean_words` are of all texts, `key` is the type of their keys."""

    spark: SparkSession
    path: str
    texts: int
    mean_words: float
    parts: int
    key: str

    @classmethod
    def write(
        cls, df: DataFrame, key: str, text: str, path: str, pattern: str = WORD, block_texts: int = BLOCK_TEXTS, parts: int = PARTS
    ) -> TextIndex:
        spark = df.sparkSession
        words = df.select(F.col(key).alias("key"), tokens(F.col(text), pattern).alias("words"))
        lengths = words.select("key", F.greatest(F.size("words"), F.lit(0)).alias("length"), "words")
        per_key = lengths.groupBy("key", "length").agg(F.count(F.lit(1)).alias("rows"))
        words_in_all = F.sum(F.col("length") * F.col("rows")).cast("double")
        total = per_key.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("texts"),
            F.coalesce(words_in_all / F.sum("rows"), F.lit(0.0)).alias("mean"),
            F.max("rows").alias("most"),
        ).first()
        blocks = max(1, math.ceil(total.texts / block_texts))
        # a text's words are counted within its row, and one shuffle, by place in the index, is all that follows:
        # rows of a key that is repeated meet there too, as a key has one block
        held = (
            lengths.select("key", "length", F.sort_array("words").alias("words"))
            .withColumn("starts", _run_starts(F.col("words")))
            .select("key", "length", F.inline(_runs(F.col("words"), F.col("starts"))))
            .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
            .withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
        )
        order = ("part", "term", "block")
        placed = held.repartitionByRange(*order)
        if (total.most or 0) > 1:
            placed = placed.groupBy(*order, "key", "length").agg(F.sum("count").alias("count"))
        weight = F.col("count") * (K1 + 1) / (F.col("count") + K1 * (1 - B + B * F.col("length") / max(total["mean"], 1e-9)))
        postings = (
            placed.withColumn("weight", weight)
            .groupBy(*order)
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.max("weight").alias("bound"),
                F.collect_list(F.struct("key", F.col("count").cast("int").alias("tf"), "weight")).alias("postings"),
            )
            .select("term", "block", "n", "bound", "postings", "part")
        )
        postings.sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{path}/postings")
        kind = words.schema["key"].dataType.simpleString()
        about = [(total.texts, total["mean"], parts, kind)]
        rows = spark.createDataFrame(about, "texts bigint, mean_words double, parts int, key string")
        rows.coalesce(1).write.parquet(f"{path}/about")
        return cls(spark, path, *about[0])

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TextIndex:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(spark, path, about.texts, about.mean_words, about.parts, about.key)

    def _rows(self) -> DataFrame:
        postings = f"array<struct<key:{self.key},tf:int,weight:double>>"
        schema = f"term string, block int, n bigint, bound double, postings {postings}, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The rows of some terms."""
        hashes = [F.pmod(F.xxhash64(F.lit(t)), F.lit(self.parts)).cast("int") for t in terms]
        parts = self.spark.range(1).select(F.array(*hashes).alias("parts")).first().parts
        return self._rows().where(F.col("part").isin(sorted(set(parts))) & F.col("term").isin(sorted(set(terms))))

    def _weighted(self, terms: Sequence[str]) -> DataFrame | None:
        """The rows of some terms with `idf`, times the number of times a term is asked for."""
        rows = self.postings(terms)
        with_term = {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if not with_term:
            return None
        idf = {
            t: terms.count(t) * math.log(1.0 + (self.texts - n + 0.5) / (n + 0.5)) for t, n in with_term.items()
        }
        pairs = [x for t, w in sorted(idf.items()) for x in (F.lit(t), F.lit(w))]
        times = [x for t in sorted(idf) for x in (F.lit(t), F.lit(terms.count(t)))]
        return rows.withColumn("idf", F.create_map(*pairs)[F.col("term")]).withColumn("times", F.create_map(*times)[F.col("term")])

    def _scored(self, rows: DataFrame) -> DataFrame:
        held = rows.select("idf", "times", F.explode("postings").alias("p"))
        return held.groupBy(F.col("p.key").alias("key")).agg(
            F.sum(F.col("p.tf") * F.col("times")).cast("bigint").alias("matches"), F.sum(F.col("idf") * F.col("p.weight")).alias("score")
        )

    def search(self, terms: Sequence[str], best: int | None = None) -> DataFrame:
        """(key, matches, score) of all texts that hold a term, or of the `best` by score, equal ones by key."""
        rows = self._weighted(list(terms)) if terms else None
        if rows is None:
            empty = self._rows().where(F.lit(False)).withColumn("idf", F.lit(0.0)).withColumn("times", F.lit(0))
            return self._scored(empty)
        if best is None:
            return self._scored(rows)
        # the bounds are read without the postings
        blocks = rows.groupBy("block").agg(F.sum(F.col("idf") * F.col("bound")).alias("most"))
        first = [r.block for r in blocks.orderBy(F.desc("most"), "block").limit(FIRST_BLOCKS).collect()]
        reached = self._scored(rows.where(F.col("block").isin(first))).orderBy(F.desc("score")).limit(best)
        least = reached.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
        # bounds and scores are sums in different orders
        floor = least.score * (1 - 1e-9) if least.n == best else -math.inf
        open_blocks = blocks.where(F.col("most") >= floor).select("block")
        return self._scored(rows.join(open_blocks, "block")).orderBy(F.desc("score"), "key").limit(best)
