"""Offline stand-ins for models, all deterministic, and retries for remote ones.

Each can be replaced by a callable of the same shape: embedder (text -> vector), scorer
(question, text -> score), generator (see ``answering.answer``), judge (expected, answer -> 0..1).
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, tokens

REFUSAL = "The provided context does not contain enough information to answer."


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of words in ``dim`` hashed places (up to 65536): the first four digits of a word's MD5.

    Each word is read and hashed once: the places are sorted among one more of each place, so that
    where a place begins tells how often the one before it occurs.
    """
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    place = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(dim)))
    every = F.sort_array(F.concat(F.sequence(F.lit(0), F.lit(dim - 1)), place))
    begins = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda j: (j == 1) | (F.get(s, j - 1) != F.get(s, j - 2)))
    counts = lambda b, n: F.zip_with(b, F.concat(F.slice(b, 2, dim), F.array(n + 1)), lambda at, then: (then - at - 1).cast("float"))
    return bound(every, lambda s: bound(begins(s), lambda b: counts(b, F.size(s))))


def lexical_score(question: Column, text: Column) -> Column:
    """Share of the question's different words in the text, on the scale of logits: -10 to 10."""
    asked = F.array_distinct(tokens(question))
    found = F.size(F.array_intersect(asked, tokens(text)))
    return F.when(F.size(asked) > 0, found / F.size(asked) * 20.0 - 10.0).otherwise(F.lit(-10.0))


def extractive(ready: DataFrame) -> DataFrame:
    """The sentence of the context that shares most words with the question; a refusal if none shares any."""
    sentences = F.filter(F.split("context", r"(?<=[.!?])\s+|\n+"), lambda s: F.length(s) > 0)
    asked = F.array_distinct(tokens("question"))
    weighed = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(asked, tokens(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(weighed)
    return ready.withColumn("answer", F.when(best.n > 0, best.s).otherwise(REFUSAL))


def token_f1(expected: Column, answer: Column) -> Column:
    """A proxy for a judge: harmonic mean of the shares of common different words."""
    a, b = F.array_distinct(tokens(expected)), F.array_distinct(tokens(answer))
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def support(context: Column, answer: Column) -> Column:
    """A proxy for faithfulness: share of the answer's different words that the context holds."""
    said = F.array_distinct(tokens(answer))
    return F.when(F.size(said) > 0, F.size(F.array_intersect(said, tokens(context))) / F.size(said)).otherwise(F.lit(0.0))


# Fixed values of the retry policy.
ATTEMPTS, LEAST_WAIT, MOST_WAIT = 6, 2.0, 65.0
LIMITED = re.compile(r"rate_limit|429")


def with_retry(call: Callable, *args, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """Call a remote model; on messages of a rate limit wait, ever longer, and try again."""
    for n in range(attempts):
        try:
            return call(*args)
        except Exception as e:
            if n + 1 == attempts or not LIMITED.search(str(e)):
                raise
            sleep(min(MOST_WAIT, LEAST_WAIT * 2**n) * (1 + random.random() / 10))


def remote_generator(client: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """A generator that asks ``client`` for each prompt, in batches per task."""

    def generate(ready: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.assign(answer=[with_retry(client, p) for p in batch["prompt"]])

        return ready.mapInPandas(run, ready.withColumn("answer", F.lit("")).schema)

    return generate
