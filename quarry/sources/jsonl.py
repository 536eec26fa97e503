"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _blank(line: str) -> Column:
    return F.length(F.regexp_replace(line, r"(?U)\s+", "")) == 0


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must be an object of the schema; a blank or bad one fails the query that reads it."""
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    checked = F.when(_blank("value"), F.raise_error(F.lit("a blank line"))).otherwise(row)
    return spark.read.text(path).select(checked.alias("row")).select("row.*")


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped, though counted; bad ones raise, the first five with file, line number and text in the message."""
    lines = spark.read.text(path).filter(~_blank("value"))
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    bad = [r[0] for r in parsed.filter("row._bad is not null").select("value").limit(5).collect()]
    if bad:
        at = numbered(spark, path).filter(F.col("value").isin(bad)).orderBy("file", "line").limit(5).collect()
        raise ValueError("lines that are no JSON objects: " + "; ".join(f"{r.file}, line {r.line}: {r.value}" for r in at))
    return parsed.select("row.*").drop("_bad")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line; blocks of a file are counted apart and added up."""
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = own.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return own.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def write_jsonl(df: DataFrame, path: str) -> None:
    """UTF-8, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
