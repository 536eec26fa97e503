"""Rows of each pipeline stage against brute force, with odd rows in its input."""

import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, quality

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents, some rows twice, without an id, with an id of others, without text."""
    rows = [row(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [rows[3], (None, *rows[5][1:]), (rows[7][0], *rows[8][1:]), (9001, None, "en", "src0", None), (9002, "", None, None, 0), (None, None, None, None, None), (9003, "one", "en", None, 3)]
    return rows


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_quality_stage(spark, docs):
    """Perplexities have a test of their own; here the thresholds, verdicts and rows."""
    df, labels = made(spark, docs), spark.read.parquet(f"{DATA}/labels.parquet")
    told = quality.classify(df.withColumn("size", F.octet_length("text")), labels, carry=("size", "text")).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 1).collect()
    by_id = collections.defaultdict(list)
    for r in labels.collect():
        by_id[r.doc_id].append(r.quality == 1 and not r.toxic)
    trusted = {i for i, v in by_id.items() if all(v)}
    held = [r for r in told if r.doc_id in trusted and r.held and r.perplexity is not None]

    def least(values, q=quality.QUANTILE):
        values = sorted(values)
        return values[math.ceil(q * len(values)) - 1]

    everywhere = least([r.perplexity for r in held])
    assert len(told) == len(docs)
    kept = collections.Counter()
    for r in told:
        own = [h.perplexity for h in held if h.lang == r.lang and r.lang is not None]
        limit = everywhere if not own else least(own) if len(own) * (1 - quality.QUANTILE) >= 1 - 1e-9 else max(least(own), everywhere)
        fine = r.perplexity is not None and r.perplexity <= limit * math.exp(quality.SLACK / r["size"])
        assert r.kept == fine
        kept[(r.doc_id, r.lang, r.text)] += fine
    want = sorted((d for d in docs if kept[(d[0], d[2], d[1])]), key=repr)
    assert sorted(map(row, corpus_pipeline.quality(spark, df, DATA).collect()), key=repr) == want
    assert (None, *docs[5][1:]) in want


def test_repeated_strings_stage(spark, docs):
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(2, 7))) for _ in range(n))
    long, short = prose(60), prose(46)
    rows = docs[:40] + docs[-7:] + [(9100 + k, f"{prose(20)} {p} {prose(20)}", "en", "s", 1) for k, p in enumerate([long, long, short, short])]
    width, least = corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS
    data = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    want = []
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        for a, b in zip(edges[::2], edges[1::2]):
            if len(d[a:b].split()) < least:
                gone[a:b] = False
        text = bytes(np.frombuffer(d, np.uint8)[~gone]).decode(errors="ignore")
        want.append((r[0], text, r[2], r[3], len(text)))
    got = list(map(row, corpus_pipeline.repeated_strings(spark, made(spark, rows), DATA).collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    texts = {r[0]: r[1] for r in got}
    assert texts[9102] == rows[-2][1] and long[20:-20] not in texts[9100]


def test_mixture_stage(spark, docs):
    sized = made(spark, docs).withColumn("size", mixing.word_count(F.col("text")))
    copies, words, taken, targets = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for r in mixing.mix_sources(sized).collect():
        copies[row(r)] += r.copies
        words[r.source] += r.size
        taken[r.source] += r.size * r.copies
        targets[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert abs(sum(targets.values()) - sum(words.values())) < 1e-6 * sum(words.values())
    assert all(abs(taken[s] - t) <= 2 * max(len((d[1] or "").split()) for d in docs if d[3] == s) for s, t in targets.items())
    got = collections.Counter(map(row, corpus_pipeline.mixture(spark, made(spark, docs), DATA).collect()))
    assert got == +copies


def test_token_stage(spark, docs):
    from tiktoken.load import load_tiktoken_bpe

    bpe = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    want = []
    for r in docs:
        ids = bpe.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.token_ids(spark, made(spark, docs), DATA).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_of_no_rows(spark):
    empty = made(spark, [])
    assert all(stage(spark, empty, DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)
