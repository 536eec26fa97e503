"""Text expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text) -> Column:
    """Trim every kind of white space; Spark's trim knows the blank only."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def tokens(text) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def heading_word(source_file) -> Column:
    return F.when(F.lower(source_file).contains("rule"), "Rule").otherwise("Section")


def chunk_id(source_file, section, number) -> Column:
    """An empty section counts as none."""
    named = F.when(F.length(section) > 0, section).otherwise("preamble")
    return F.concat_ws("::", source_file, named, number.cast("string"))


def citation_label(source_file, section) -> Column:
    """Null where the section is."""
    return F.concat(source_file, F.lit(" :: "), section)


def context_label(source_file, section, text) -> Column:
    """A missing file or section prints as None."""
    return F.concat(F.lit("["), F.coalesce(source_file, F.lit("None")), F.lit(" :: "), F.coalesce(section, F.lit("None")), F.lit("]\n"), text)


def snippet(text, keyword: str, before: int = 80, after: int = 200) -> Column:
    """What stands around the first match, without regard to case, on one line."""
    at = F.instr(F.lower(text), keyword.lower())
    first = F.greatest(F.lit(1), at - before)
    cut = F.substring(text, first, at + len(keyword) + after - first)
    return F.when(at > 0, F.translate(cut, "\n", " "))


def amount(line) -> Column:
    """The number after the last colon of a line: currency mark and thousands commas dropped."""
    number = F.regexp_extract(line, r"(?i):[^:\d]*?(-?[\d,]+(?:\.\d+)?)\s*\z", 1)
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def map_sum(amounts) -> Column:
    """Sum of a map's values, 0 for none."""
    return F.coalesce(F.aggregate(F.map_values(amounts), F.lit(0.0), lambda total, x: total + x), F.lit(0.0))
