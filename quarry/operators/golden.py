"""Checks of a set of golden questions, and browsing of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation_label, snippet, strip

# Names of fields, and what difficulties there are.
REQUIRED = ["id", "question", "expected_answer", "source_file", "source_clause", "category", "difficulty"]
MAY_NOT_BE_EMPTY = ["question", "expected_answer", "source_file", "source_clause", "category"]
DIFFICULTIES = ["easy", "medium", "hard"]


def missing_fields(fields: Column) -> Column:
    """Required names that are no key of the map; a key with a null value is there."""
    return F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys(fields))


def check_missing(rows: DataFrame) -> DataFrame:
    """rows: pos, fields (map). Such rows take no part in the other checks."""
    return rows.select("pos", F.lit(1).alias("check_no"), F.explode(missing_fields(F.col("fields"))).alias("detail"))


def complete(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size(missing_fields(F.col("fields"))) == 0).select("pos", *[F.col("fields")[c].alias(c) for c in REQUIRED])


def check_duplicates(full: DataFrame) -> DataFrame:
    """Second and later rows of an id. Counts before each row come from the first position of the id, so no id fills a window."""
    first = full.groupBy(F.col("id").alias("_id")).agg(F.min("pos").alias("first"))
    return full.join(first, F.col("id").eqNullSafe(F.col("_id"))).filter(F.col("pos") > F.col("first")).select("pos", F.lit(2).alias("check_no"), F.col("id").alias("detail"))


def check_empty(full: DataFrame) -> DataFrame:
    empty = F.array_compact(F.array(*[F.when(F.coalesce(strip(c), F.lit("")) == "", c) for c in MAY_NOT_BE_EMPTY]))
    return full.select("pos", F.lit(3).alias("check_no"), F.explode(empty).alias("detail"))


def check_domain(full: DataFrame) -> DataFrame:
    return full.filter(~F.coalesce(F.col("difficulty").isin(DIFFICULTIES), F.lit(False))).select("pos", F.lit(4).alias("check_no"), F.col("difficulty").alias("detail"))


def check_referential(full: DataFrame, chunks: DataFrame) -> DataFrame:
    known = chunks.filter("section is not null").select("source_file", F.col("section").alias("source_clause")).distinct()
    return full.join(known, ["source_file", "source_clause"], "left_anti").select("pos", F.lit(5).alias("check_no"), citation_label(F.col("source_file"), F.col("source_clause")).alias("detail"))


def dq_report(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """All errors (pos, check_no, detail), to be ordered by these."""
    full = complete(rows)
    parts = [check_missing(rows), check_duplicates(full), check_empty(full), check_domain(full), check_referential(full, chunks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("?")).alias(column)).agg(F.count("*").alias("n"))


def list_sections(chunks: DataFrame) -> DataFrame:
    """Different labels of chunks that have a section."""
    return chunks.filter("section is not null").select(citation_label(F.col("source_file"), F.col("section")).alias("label")).distinct()


def with_section(chunks: DataFrame, section: str) -> DataFrame:
    return chunks.filter(F.col("section") == section)


def with_keyword(chunks: DataFrame, keyword: str) -> DataFrame:
    found = chunks.filter(F.contains(F.lower("text"), F.lit(keyword.lower())))
    return found.withColumn("snippet", F.concat(F.lit("["), "chunk_id", F.lit("] ..."), snippet(F.col("text"), keyword), F.lit("...")))


def browse(chunks: DataFrame, sections: bool = False, section: str | None = None, keyword: str | None = None) -> DataFrame:
    """What the first option given asks for: the list of sections, a section's chunks, or a keyword's; an empty string is not given."""
    if sections:
        return list_sections(chunks)
    if section:
        return with_section(chunks, section)
    if keyword:
        return with_keyword(chunks, keyword)
    raise ValueError("give sections, section or keyword")
