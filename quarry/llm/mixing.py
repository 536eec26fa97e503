"""Operator 3: mix sources to target weights by systematic sampling.

DataFrame operations only.  A document's expected copies are its source's target
over its source's size, the same for all documents of a source; so the prefix sum
of expected copies is that ratio times the document's rank.  Ranks come from
counts in three levels (source and size; block of ids; row), hence no task has to
hold a whole source.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Consecutive doc_ids that share a block; rows of one source and size are ranked block by block.
BLOCK_IDS = 256


def word_count(text) -> F.Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """Targets of sources (source, source_size).

    Sources in code-point order, null last, weigh 1, 2, .., ``cycle``, 1, ..  They
    share the total by weight, none above ``cap`` times its size.  The sources that
    reach the cap are those with the least cap per weight; the level of the others
    follows from prefix sums in that order.  Windows here run over one row a source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("most", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / behind
    leveled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_cap))
    free = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("place"))
    leveled = leveled.withColumn("free", free)
    final = F.min_by("level", "free").over(everything)
    return leveled.withColumn("final", final).select("source", "source_size", F.least(F.col("final") * F.col("weight"), "most").alias("target"))


def mix_sources(docs: DataFrame, cycle: int = 3, cap: int = 3, seed: int = 42, targets: DataFrame | None = None) -> DataFrame:
    """How often the mix takes each document.

    ``docs`` has doc_id, source and size (long), and may have more columns, all
    kept.  Adds source_size, target and copies (long).  Documents of a source are
    ranked by (size, doc_id), so the words taken differ from the target by about
    one document's words at most.  One offset a source, from ``seed``: reruns
    agree.  Documents without words are ranked like others and take no words;
    null sources form one source, repeated rows count each, and rows that share a
    doc_id are ranked in either order.  A source of size 0 takes nothing.
    ``targets`` (source, source_size, target) replaces the computed ones.
    """
    key = ["_null", "_source", "size", "_block"]
    # rows without doc_id go to blocks in front of all others, by what else they hold
    told = [f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    nowhere = F.pmod(F.xxhash64(*told), F.lit(1 << 20)) - (1 << 62)
    keyed = docs.withColumns(
        {
            "_null": F.col("source").isNull(),
            "_source": F.coalesce("source", F.lit("")),
            "_block": F.coalesce(F.floor(F.col("doc_id") / BLOCK_IDS), nowhere),
        }
    )
    counts = keyed.groupBy(*key).agg(F.count("*").alias("n"))
    by_size = counts.groupBy(*key[:3]).agg(F.sum("n").alias("n"))
    sources = by_size.groupBy(*key[:2]).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    if targets is None:
        targets = source_targets(sources.select(F.when(~F.col("_null"), F.col("_source")).alias("source"), "source_size"), cycle, float(cap))
    targets = targets.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    upto = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    of_size = by_size.withColumn("_a", F.coalesce(F.sum("n").over(upto(key[:2], "size")), F.lit(0))).drop("n")
    of_block = counts.withColumn("_b", F.coalesce(F.sum("n").over(upto(key[:3], "_block")), F.lit(0))).drop("n")
    starts = of_block.join(of_size, key[:3]).join(targets, key[:2])
    rank = F.col("_a") + F.col("_b") + F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
    ranked = keyed.join(starts, key).withColumn("_rank", rank)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("_null", "_source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    upto_row = lambda r: F.floor(F.col("_ratio") * r + F.col("_offset"))
    return (
        ranked.withColumns({"_ratio": ratio, "_offset": offset})
        .withColumn("copies", (upto_row(F.col("_rank")) - upto_row(F.col("_rank") - 1)).cast("long"))
        .drop(*key[:2], "_block", "_a", "_b", "_rank", "_ratio", "_offset")
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_copy")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix_sources`` over all ``documents``: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
