"""Documents to token ids: a pipeline of stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.llm import bpe, frames, quality
from metricspark.llm.decontamination import with_leaks
from metricspark.llm.jaccard import jaccard_join
from metricspark.llm.lines import dedup_lines

# what stages hand on: the columns of documents
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of `sf_dir`."""
    frames.small_batches(spark)
    model = quality.fit(docs, frames.table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them share; n_chars counts what is left."""
    frames.small_batches(spark)
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, a null id last, of these any.

    Rows are told apart by a number of their own, so that rows without an id, or with the same one, are judged apart.
    """
    frames.small_batches(spark)
    rows = frames.stage(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    classes = jaccard_join(rows, "row").select("row", "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.select("row", "doc_id").join(classes, "row").groupBy("class_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    frames.small_batches(spark)
    found = with_leaks(docs, frames.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text.

    The ids are written first and decoded as they are read: a task needs one Python worker at a time, not two.
    """
    frames.small_batches(spark)
    tokenizer = bpe.with_lexicon(docs, "text", VOCABULARY)
    encoded = frames.stage(docs.select("doc_id", "text", tokenizer.encode(F.col("text")).alias("ids")), "encoded")
    return encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (tokenizer.decode(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

# a trained network and similarity over shingles have no twin in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs = frames.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = frames.stage(stage(spark, docs, sf_dir), "pipeline")
    return docs
