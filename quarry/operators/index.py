"""Stored indexes: built once, dropped and recreated on a new build, reopened by path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import file_system
from .retrieval import bm25_stats, corpus_size, listed, postings

VECTORS = "chunk_id string, embedding array<float>"
_DOCS, _STATS, _SIZE = "chunk_id string, chunk_ord long, dl int, words array<struct<tok: string, tf: long>>, copies long, shared boolean", "tok string, df long, idf double", "n long, avgdl double"


@dataclass(frozen=True)
class LexicalIndex:
    """docs (what ``retrieval.listed`` gives, a row a chunk), stats (tok, df, idf), size (one row: n, avgdl) and the first chunks of the corpus (chunk_id, chunk_ord)."""

    docs: DataFrame
    stats: DataFrame
    size: DataFrame
    first: DataFrame

    @property
    def postings(self) -> DataFrame:
        """tok, chunk_id, chunk_ord, dl, tf."""
        return postings(self.docs)


def lexical_index(chunks: DataFrame) -> LexicalIndex:
    """An index that is not stored: its parts are computed by each query."""
    docs = listed(chunks)
    size = corpus_size(docs)
    return LexicalIndex(docs, bm25_stats(postings(docs), size), size, chunks.select("chunk_id", "chunk_ord"))


def build_lexical_index(chunks: DataFrame, folder: str) -> None:
    """Write the index of ``chunks`` (chunk_id, chunk_ord, text); one that is there goes.

    Words and their numbers lie with their chunk, as they are counted there, so that building moves no postings, and
    a search adds up scores of many questions in place.
    """
    spark = chunks.sparkSession
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
    write(listed(chunks), "docs")
    docs = spark.read.schema(_DOCS).parquet(f"{folder}/docs")
    write(corpus_size(docs), "size")
    write(bm25_stats(postings(docs), spark.read.schema(_SIZE).parquet(f"{folder}/size")), "stats")


def open_lexical_index(spark: SparkSession, folder: str) -> LexicalIndex:
    """A missing index raises here, not when it is searched."""
    _there(spark, folder, "stats")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    docs = read("docs", _DOCS)
    return LexicalIndex(docs, read("stats", _STATS), read("size", _SIZE), docs.select("chunk_id", "chunk_ord"))


def build_vector_index(chunks: DataFrame, embedder, folder: str, text: str | Column = "text") -> None:
    """Embed ``chunks`` and write chunk_id and embedding; an index that is there goes."""
    vectors = chunks.select("chunk_id", embedder(F.col(text) if isinstance(text, str) else text).alias("embedding"))
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")


def open_vector_index(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, embedding; a missing index raises here."""
    _there(spark, folder, "vectors")
    return spark.read.schema(VECTORS).parquet(f"{folder}/vectors")


def _there(spark: SparkSession, folder: str, part: str) -> None:
    files, where = file_system(spark, f"{folder}/{part}/_SUCCESS")
    if not files.exists(where):
        raise FileNotFoundError(f"no index at {folder}; build it first")
