"""From raw documents to token ids, in five stages.

Each stage reads what the one before wrote.  All but the last return the columns of
``documents``; the driver of the stages, ``run`` here, writes Parquet between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_digests
from quarry.llm.common import stored, table
from quarry.llm.mixing import emit_copies, mix_sources, word_count
from quarry.llm.quality import keep_good
from quarry.llm.shingle_join import near_texts
from quarry.llm.suffix_dedup import drop_repeats

#: No SQL: perplexities, MinHash and transforms are no SQL. The tests hold the operators, and each stage's rows, against brute-force versions.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Passages of this many words and more that occur twice go in the suffix-array stage.  They are searched for as
#: repeated strings of ``PASSAGE_BYTES``: fifty words of three letters with their blanks.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_SYMBOL = 50, 200, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Each row is judged by its own text, whether its doc_id is null, repeats or not; null and empty
    texts are not kept, repeated rows all or none.  No labels: all with text stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity one row, that with the smallest doc_id.

    Rows are told apart by all their columns, so different texts that share a doc_id, or have
    none, are judged each; a row without doc_id stays if no row of its group has one.  Rows equal in
    every column are one; texts without words link with nothing and stay.
    """
    keyed = docs.withColumn("_row", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))
    told = near_texts(keyed.select(F.col("_row").alias("doc_id"), "text"), counted=False).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = keyed.select("doc_id", "_row").join(stored(told, "told"), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(first.select("first._row"), "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of ``PASSAGE_WORDS`` words or more; a character that loses a byte goes.

    All places of a passage go, also within one document; a row each for all rows, so repeated rows
    lose their text to each other if it is long enough.  Null text becomes empty, short texts stay.
    """
    rest = drop_repeats(docs, window=PASSAGE_BYTES, symbol=PASSAGE_SYMBOL, as_text=True, carry=("lang", "source"), least_words=PASSAGE_WORDS)
    return rest.withColumn("text", F.col("rest")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources form one; documents without words have size 0 and are taken like others of their
    source; repeated rows and null doc_ids count each.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    return emit_copies(mix_sources(sized)).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, encoded and decoded: their number and digests.

    A row each for all rows; null and empty texts have no ids.
    """
    return bpe_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources", mixture),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
