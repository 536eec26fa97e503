"""Sections of legal documents: window functions in place of a page-by-page parser.

A document is the unit of order, so its windows run in one task each; documents run side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_word, strip

# The shapes of headings and schedule boundaries.
HEADING = r"(\d{1,3})\.\s{1,4}([A-Z][A-Za-z,\-\s]{2,100}):"
SCHEDULE = r"Schedule[\s\-]?(\d{1,2})\s*\n\s*\(Relating to Section"


def detect_events(pages: DataFrame) -> DataFrame:
    """Cut pages before each heading and schedule boundary: source_file, page_number, pos, piece, heading, schedule (numbers or null).

    Pieces joined again give the page.
    """
    cuts = rf"(?=\n{HEADING})|(?<!\s)(?=\s*\n\s*{SCHEDULE})"
    pieces = pages.select("source_file", "page_number", F.posexplode(F.split("text", cuts)).alias("pos", "piece"))
    number = lambda pattern: F.regexp_extract("piece", pattern, 1).try_cast("int")
    schedule = number(rf"\A\s*{SCHEDULE}")
    return pieces.withColumn("schedule", schedule).withColumn("heading", F.when(F.col("schedule").isNull(), number(rf"\A\n?{HEADING}")))


def accept_events(events: DataFrame) -> DataFrame:
    """Which events open a section (adds sched_ord, schedule_num, accepted, label).

    From the first schedule boundary on a document stays in schedules.  A heading counts if its
    number exceeds all before it: since the document's begin, or since the last boundary.
    """
    order = Window.partitionBy("source_file").orderBy("page_number", "pos")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), Window.unboundedPreceding
    df = events.withColumn("sched_ord", F.sum(F.col("schedule").isNotNull().cast("int")).over(upto))
    within = Window.partitionBy("source_file", "sched_ord").orderBy("page_number", "pos").rowsBetween(before, -1)
    df = df.withColumn("schedule_num", F.last("schedule", ignorenulls=True).over(upto))
    higher = F.col("heading") > F.coalesce(F.max("heading").over(within), F.lit(-1))
    df = df.withColumn("accepted", F.col("schedule").isNotNull() | F.coalesce(higher, F.lit(False)))
    label = (
        F.when(F.col("schedule").isNotNull(), F.format_string("Schedule %d", "schedule"))
        .when(F.col("sched_ord") > 0, F.format_string("Schedule %d Item %d", "schedule_num", "heading"))
        .otherwise(F.concat(heading_word(F.col("source_file")), F.lit(" "), F.col("heading").cast("string")))
    )
    return df.withColumn("label", F.when(F.col("accepted"), label))


def segments(pages: DataFrame) -> DataFrame:
    """Labelled segments: source_file, page_number, seg_pos, text, detected_clause.

    A rejected heading stays in its segment; text before a page's first section carries the last label on.
    """
    df = accept_events(detect_events(pages))
    order = Window.partitionBy("source_file").orderBy("page_number", "pos").rowsBetween(Window.unboundedPreceding, 0)
    on_page = Window.partitionBy("source_file", "page_number").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("clause", F.last("label", ignorenulls=True).over(order)).withColumn("seg_pos", F.sum(F.col("accepted").cast("int")).over(on_page))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x.piece), "")
    merged = df.groupBy("source_file", "page_number", F.col("seg_pos").cast("int").alias("seg_pos")).agg(strip(text).alias("text"), F.min("clause").alias("detected_clause"))
    return merged.filter(F.length("text") > 0)


def segment_stats(segs: DataFrame) -> DataFrame:
    return segs.agg(F.count("*").alias("total"), F.count_if(F.col("detected_clause").isNotNull()).alias("labelled"), F.count_if(F.col("detected_clause").contains("Schedule")).alias("in_schedules"))
