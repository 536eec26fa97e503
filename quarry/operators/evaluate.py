"""Scores of retrieval, answers and extraction, as joins and aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_label


def first_relevant(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """golden with found_at_rank: the first hit of its file and section, null if none.  golden: qid, source_file, section."""
    gold = golden.select("qid", F.col("source_file").alias("_f"), F.col("section").alias("_s"))
    right = hits.join(gold, "qid").filter(F.col("source_file").eqNullSafe(F.col("_f")) & F.col("section").eqNullSafe(F.col("_s")))
    return golden.join(right.groupBy("qid").agg(F.min("rank").alias("found_at_rank")), "qid", "left")


def recall(rank: str = "found_at_rank") -> Column:
    """Share of all questions, found or not."""
    return F.avg(F.col(rank).isNotNull().cast("double"))


def mrr(rank: str = "found_at_rank") -> Column:
    return F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0)))


def summary(told: DataFrame, *by: str) -> DataFrame:
    return told.groupBy(*by).agg(F.count("*").alias("total_questions"), recall().alias("recall_at_k"), mrr().alias("mrr"))


def report(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question its first relevant rank and the label of its top result."""
    top = hits.filter("rank = 1").select("qid", citation_label(F.col("source_file"), F.col("section")).alias("top_result"))
    return first_relevant(golden, hits).join(top, "qid", "left")


def compare(golden: DataFrame, variants: dict[str, DataFrame]) -> DataFrame:
    """The summary of several lists of hits side by side."""
    told = None
    for name, hits in variants.items():
        one = first_relevant(golden, hits).withColumn("variant", F.lit(name))
        told = one if told is None else told.unionByName(one)
    return summary(told, "variant")


def gold_context(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of each question's file and section."""
    return golden.select("qid", "source_file", "section").join(chunks.select("chunk_id", "text", "source_file", "section"), ["source_file", "section"])


def gold_context_errors(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    return golden.join(chunks.select("source_file", "section").distinct(), ["source_file", "section"], "left_anti")


def calibrate(scores: DataFrame) -> DataFrame:
    """min, max, mean and exact median of top scores in and out of scope (scope, score); a missing score is minus infinity."""
    value = F.coalesce(F.col("score"), F.lit(float("-inf")))
    return scores.withColumn("v", value).groupBy("scope").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.median("v").alias("median"))


def separation(calibrated: DataFrame) -> DataFrame:
    """Whether the worst score in scope beats the best out of scope."""
    worst = F.max(F.when(F.col("scope") == "in", F.col("min")))
    best = F.max(F.when(F.col("scope") == "out", F.col("max")))
    return calibrated.agg(worst.alias("worst_in"), best.alias("best_out")).withColumn("verdict", F.when(F.col("worst_in") > F.col("best_out"), "clean").otherwise("overlap"))
