"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all documents it gets.

All but the last return the columns of docs. Rows that stay keep their other columns, null or repeated ids and
empty texts are judged like others, and an empty table stays empty. Whole rows go through Python workers one stage after
another in the same executors, so the stages with such workers ask for small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small_batches
from . import anchors, decontaminate, line_runs, packing, toxicity
from .common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Documents that score at least threshold go. Learns from the labelled rows among docs."""
    small_batches(spark)
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return toxicity.score_documents(rows, scorer, ["row"]).where(F.col("score") < threshold).select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; n_chars follows the text. Documents left without text stay."""
    out = line_runs.drop_frequent_lines(docs)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard similarity of 0.8 or more, verified."""
    small_batches(spark)
    return anchors.one_of_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with at most 5 % edits, go."""
    small_batches(spark)
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, remembered=200_000)
