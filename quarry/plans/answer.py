"""Whole flows: questions to answers, pages to chunks, slips to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import answering, chunks, models, retrieval, sections, slips
from ..operators.index import LexicalIndex, lexical_index


def ask(
    questions: DataFrame, corpus: DataFrame, dense: DataFrame, scorer=models.lexical_score, generator=models.extractive, k: int = retrieval.TOP, threshold: float = answering.THRESHOLD, lexical: LexicalIndex | None = None
) -> DataFrame:
    """Answers to all ``questions`` (qid, question) in one job; blank questions get none.

    ``dense``: qid, chunk_id, rank.  ``lexical``: a stored index of the corpus, else it is computed.  ``k`` above the pool of 15 gives 15.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    questions = questions.filter(F.length(strip("question")) > 0)
    hits = retrieval.retrieve_reranked(questions, corpus, lexical or lexical_index(corpus), dense, scorer, k)
    return answering.answer(questions, hits, generator, threshold)


def index(pages: DataFrame) -> DataFrame:
    """Chunks of page texts."""
    return chunks.chunks(sections.segments(pages))


def extract(raw: DataFrame, every: bool = False) -> DataFrame:
    """Records of slips (id, slip_text) with arithmetic warnings.

    Those with missing or negative amounts are left to ``slips.validated``, unless ``every`` asks for them, with a column ``violations``.
    """
    read = slips.parse_slips(raw)
    return slips.checked(read) if every else slips.validated(read)[0]


def health(spark: SparkSession) -> dict[str, str]:
    """What a probe of the service is told."""
    return {"status": "ok", "spark": spark.version}
