"""Section-aware chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id

# Budget, overlap and where a block may be cut, best first.
BUDGET, OVERLAP = 400, 50
SEPARATORS = [r"\n\([a-z]+\)\s", r"\n\(\d+\)\s", r"\n\n", r"\n", r"\. ", r" "]
#: The separator that, taken as a pattern, cuts before the last letter of words.
LEGACY_SENTENCE = r". "

TOKEN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"


def count_tokens(text: str) -> int:
    """An offline stand-in for a BPE tokenizer: words and signs."""
    return len(re.findall(TOKEN, text))


def token_count(text):
    """The same count as an expression."""
    return F.regexp_count(text, F.lit(TOKEN))


def section_blocks(segs: DataFrame) -> DataFrame:
    """Number runs of equal labels (null equals null) within each file from 0: adds block."""
    order = Window.partitionBy("source_file").orderBy("page_number", "seg_pos")
    changed = (F.row_number().over(order) == 1) | ~F.col("detected_clause").eqNullSafe(F.lag("detected_clause").over(order))
    return segs.withColumn("_new", changed.cast("int")).withColumn("block", (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def assemble_blocks(blocks: DataFrame) -> DataFrame:
    """One row a block: source_file, block, section, start_page, end_page, text."""
    at = F.struct("page_number", "seg_pos")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "seg_pos", "text"))), lambda x: x.text), "\n\n")
    return blocks.groupBy("source_file", "block").agg(F.min_by("detected_clause", at).alias("section"), F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"), text.alias("text"))


def recursive_split(text: str, budget: int = BUDGET, overlap: int = OVERLAP, count: Callable[[str], int] = count_tokens, legacy_sentence_sep: bool = False) -> list[str]:
    """Cut a text by the first separator that it has, its pieces again where they are too long, and join neighbours
    up to the budget; a piece begins with up to ``overlap`` tokens of the one before.  Separators stay at the
    begin of the next piece.  A run without any separator stays whole.
    """
    seps = [LEGACY_SENTENCE if s == r"\. " and legacy_sentence_sep else s for s in SEPARATORS]

    def cut(part: str, level: int) -> list[str]:
        while level < len(seps) and not re.search(seps[level], part):
            level += 1
        if level == len(seps):
            return [part]
        edges = [0, *(m.start() for m in re.finditer(seps[level], part) if m.start()), len(part)]
        out, small = [], []
        for piece in (part[a:b] for a, b in zip(edges, edges[1:])):
            if count(piece) < budget:
                small.append(piece)
            else:
                out += join(small)
                small = []
                out += cut(piece, level + 1)
        return out + join(small)

    def join(pieces: list[str]) -> list[str]:
        out, held, sizes = [], [], []
        for piece in pieces:
            n = count(piece)
            if held and sum(sizes) + n > budget:
                out.append("".join(held))
                while held and (sum(sizes) > overlap or sum(sizes) + n > budget):
                    held, sizes = held[1:], sizes[1:]
            held, sizes = [*held, piece], [*sizes, n]
        return [*out, "".join(held)] if held else out

    return [p for p in (x.strip() for x in cut(text, 0)) if p]


def chunks(segs: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP, count: Callable[[str], int] | None = None, legacy_sentence_sep: bool = False) -> DataFrame:
    """Segments to chunks: chunk_id, text, source_file, section, start_page, end_page, token_count.

    Blocks within the budget pass whole and never reach Python (unless ``count`` replaces the default counter).
    """
    blocks = assemble_blocks(section_blocks(segs))
    if count is None:
        n = token_count(F.col("text"))
    else:
        n = F.pandas_udf(lambda s: s.map(count), "int")("text")
    blocks = blocks.withColumn("token_count", n.cast("int"))
    own = chunk_id(F.col("source_file"), F.col("section"), F.col("block"))
    columns = ["chunk_id", "text", "source_file", "section", "start_page", "end_page", "token_count"]
    small = blocks.filter(F.col("token_count") <= budget).withColumn("chunk_id", own).select(columns)
    counter = count or count_tokens

    @F.pandas_udf("array<struct<text:string,token_count:int>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": p, "token_count": counter(p)} for p in recursive_split(t, budget, overlap, counter, legacy_sentence_sep)])

    large = blocks.filter(F.col("token_count") > budget).select("source_file", "section", "start_page", "end_page", own.alias("own"), F.posexplode(pieces("text")).alias("i", "piece"))
    large = large.select(F.concat_ws(".", "own", F.col("i").cast("string")).alias("chunk_id"), "piece.text", "source_file", "section", "start_page", "end_page", "piece.token_count")
    return small.unionByName(large.select(columns))


def chunk_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.avg("token_count").alias("avg_tokens"), F.max("token_count").alias("max_tokens"), F.count_if(F.col("section").isNotNull()).alias("with_section"))
