"""Operator 4: quality classifier by an interpolated modified Kneser-Ney model.

The model counts runs of five bytes; a run fits a long, and its context and its
shorter suffix are shifts and masks of it, so all counts are DataFrame aggregates.

1. Counts come from trusted text: rows labelled of good quality and not toxic.  Half of
   their doc_ids (by hash) train, all of them; the other half, all of it, is held out
   for the thresholds.
2. Probabilities of all seen runs, and the weight that a seen context leaves to shorter
   ones, come from joins of the counts, order by order.
3. The different runs of all texts are joined, shard by shard, with the model.  Documents are dealt
   to blocks; a block asks for its different runs, and the answers go to the
   blocks, which add up their documents' log-probabilities.
4. A document is rejected if its perplexity per byte exceeds ``QUANTILE`` of those of
   all held-out trusted documents of its language by ``SLACK`` nats over the whole
   text, so that very short texts are not judged by a few bytes.

Texts move once, packed; no task holds the model.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import bounded_batches, slices, stored, table, utf8

ORDER = 5
QUANTILE = 0.99
#: Nats by which a text must exceed the threshold in all: a few odd bytes alone say nothing.
SLACK = 24.0
#: No discount is less, so that every context leaves some weight to what it has not seen.
LEAST_DISCOUNT = 0.1
#: Languages whose thresholds are sent to all tasks; more of them are joined.
MOST_LANGS = 100_000
#: Bytes of text of a block.
BLOCK_BYTES = 16 << 20
#: Blocks of small inputs: as many as there are shuffle partitions, up to these.
LEAST_BLOCKS = 64


def runs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The run of ``ORDER`` bytes that ends at each byte; zeros stand before a text."""
    place = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
    out = buf.astype(np.int64)
    for k in range(1, ORDER):
        before = np.zeros(len(buf), np.int64)
        before[k:] = buf[:-k] if len(buf) > k else 0
        before[place < k] = 0
        out |= before << (8 * k)
    return out


def _different(column) -> np.ndarray:
    buf, off = utf8(column)
    parts = [pd.unique(runs(buf[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in slices(off)]
    return pd.unique(np.concatenate([np.zeros(0, np.int64), *parts]))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids labelled good and never bad or toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("doc_id")


def count_runs(docs: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """(g, c): how often each run occurs in the documents ``ids``, a table of doc_id or a short list."""
    own = docs.join(ids, "doc_id", "left_semi") if isinstance(ids, DataFrame) else docs.filter(F.col("doc_id").isin(ids))

    def count(batches):
        for batch in batches:
            buf, off = utf8(batch.column(0))
            for a, b in slices(off):
                g, n = np.unique(runs(buf[off[a] : off[b]], off[a : b + 1] - off[a]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "n"])

    return own.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("c"))


def _mask(k: int) -> F.Column:
    return F.lit((1 << (8 * k)) - 1)


def train(counts: DataFrame) -> DataFrame:
    """The model (k, g, p, rest): probability of the run g of k bytes after its first k - 1, and the
    weight that g as a context leaves to the runs of k bytes (null: no context).

    Orders below the highest count how many different bytes stand before a run.
    """
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        longer = by_order[k + 1]
        by_order[k] = longer.groupBy(F.col("g").bitwiseAND(_mask(k)).alias("g")).agg(F.count("*").alias("c"))
    tables = [t.select(F.lit(k).alias("k"), "g", F.col("c").cast("long").alias("c")) for k, t in by_order.items()]
    all_counts = tables[0]
    for t in tables[1:]:
        all_counts = all_counts.unionByName(t)
    all_counts = stored(all_counts, "counts")
    # discounts from how many runs were counted once, twice, ..: five rows
    told = all_counts.groupBy("k").agg(*[F.count_if(F.col("c") == n).alias(f"n{n}") for n in (1, 2, 3, 4)]).collect()
    discount = F.lit(0.0)
    for k, n1, n2, n3, n4 in told:
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
        d = [max(LEAST_DISCOUNT, min(i, i - (i + 1) * y * b / a)) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        of = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        discount = F.when(F.col("k") == k, of).otherwise(discount)
    counted = all_counts.withColumns({"d": discount, "h": F.shiftright("g", 8)})
    contexts = counted.groupBy("k", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("given"))
    contexts = stored(contexts.select("k", "h", "total", (F.col("given") / F.col("total")).alias("rest")), "contexts")
    shares = stored(counted.join(contexts, ["k", "h"]).select("k", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "rest"), "shares")
    lower, found = None, None
    for k in range(1, ORDER + 1):
        now = shares.filter(F.col("k") == k)
        if lower is None:
            now = now.withColumn("p", F.col("own") + F.col("rest") / 256)
        else:
            now = now.withColumn("s", F.col("g").bitwiseAND(_mask(k - 1))).join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s").withColumn("p", F.col("own") + F.col("rest") * F.col("q"))
        lower = now = stored(now.select("g", "p"), "model")
        part = now.select(F.lit(k).alias("k"), "g", "p")
        found = part if found is None else found.unionByName(part)
    leaves = contexts.select("k", F.col("h").alias("g"), "rest")
    return found.join(leaves, ["k", "g"], "full")


def answer(asked: DataFrame, model: DataFrame) -> DataFrame:
    """(g, lp) for each of the different runs ``asked`` (g): log of the interpolated probability."""
    told = None
    for k in range(1, ORDER + 1):
        own = (asked if k == ORDER else asked.select(F.col("g").bitwiseAND(_mask(k)).alias("g")).distinct()).select("g", F.shiftright("g", 8).alias("h"), F.col("g").bitwiseAND(_mask(k - 1)).alias("s"))
        of = model.filter(F.col("k") == k)
        own = own.join(of.filter("p is not null").select("g", "p"), "g", "left").join(of.filter("rest is not null").select(F.col("g").alias("h"), "rest"), "h", "left")
        if told is None:
            shorter = F.lit(1 / 256)
        else:
            own = own.join(told.select(F.col("g").alias("s"), "q"), "s")
            shorter = F.col("q")
        told = own.select("g", F.coalesce("p", F.coalesce("rest", F.lit(1.0)) * shorter).alias("q"))
    return told.select("g", F.log("q").alias("lp"))


def _packed(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``docs`` (text first) dealt to blocks: (block, rows), compressed."""

    def pack(batches):
        for batch in batches:
            block = batch.column(batch.num_columns - 1).to_numpy()
            order = np.argsort(block, kind="stable")
            rows = batch.select(list(range(batch.num_columns - 1))).take(pa.array(order))
            edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
            press = zstandard.ZstdCompressor(level=3)
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_batch(pa.Table.from_batches([rows.slice(a, b - a)]).combine_chunks().to_batches()[0])
                out.append(press.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(block[order][edges[:-1]], pa.int32()), pa.array(out, pa.binary())], ["block", "rows"])

    dealt = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return dealt.mapInArrow(pack, "block int, rows binary")


def _unpacked(group: pa.Table):
    for raw in group.column("rows"):
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw.as_buffer())) as reader:
            yield from reader


def perplexities(docs: DataFrame, model: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, lang, text and the columns ``carry``) with n_bytes and their perplexity per byte, the text left out; null where there is no byte."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(size // BLOCK_BYTES + 1, min(partitions, LEAST_BLOCKS))
    carried = [docs.schema[c] for c in carry]
    schema = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("n_bytes", LongType()), StructField("perplexity", DoubleType()), *carried])
    packed = _packed(docs.select("doc_id", "lang", "text", *carry), blocks)

    def different(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_different(batch.column(0)))], ["g"])

    # Written, as every order of the model starts from these runs: in one plan they would be made anew for each.
    told = stored(answer(stored(docs.select("text").mapInArrow(different, "g long").distinct(), "runs"), model), "answers")

    def ask(group: pa.Table) -> pa.Table:
        g = pd.unique(np.concatenate([np.zeros(0, np.int64), *(_different(batch.column(2)) for batch in _unpacked(group))]))
        return pa.table({"block": pa.array(np.full(len(g), group.column("block")[0].as_py()), pa.int32()), "g": pa.array(g)})

    asked = packed.groupBy("block").applyInArrow(ask, "block int, g long")
    answers = asked.join(told, "g").select("block", "g", "lp")

    def score(group: pa.Table, answered: pa.Table) -> pa.Table:
        g, lp = answered.column("g").to_numpy(), answered.column("lp").to_numpy()
        order = np.argsort(g)
        g, lp = g[order], lp[order]
        out = []
        for batch in _unpacked(group):
            buf, off = utf8(batch.column(2))
            total = np.zeros(batch.num_rows)
            for a, b in slices(off):
                code, different = pd.factorize(runs(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
                sums = np.concatenate([[0.0], np.cumsum(lp[np.searchsorted(g, different)][code])]) if len(code) else np.zeros(1)
                total[a:b] = np.diff(sums[off[a : b + 1] - off[a]])
            n = np.diff(off)
            value = np.exp(-total / np.maximum(n, 1))
            own = {"doc_id": batch.column(0), "lang": batch.column(1), "n_bytes": pa.array(n), "perplexity": pa.array(value, pa.float64(), mask=n == 0)}
            out.append(pa.table(own | dict(zip(carry, batch.columns[3:]))))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Perplexity and verdict for each of ``docs`` (doc_id, lang, text).

    Returns doc_id, lang, perplexity (per byte), threshold and kept, a row per row.
    ``labels`` has doc_id, quality and toxic; a doc_id labelled twice is trusted only if
    both agree.  A document without text has no perplexity and is not kept.  A
    language with fewer than 1 / (1 - ``quantile``) held-out documents has no such
    quantile, only a largest one, and takes the threshold of all languages where that
    is greater; one without any, or null, takes that of all.  Without held-out
    documents nothing can be judged and every document that has text is kept.
    Rows that repeat a doc_id, or have none, are judged each by its text; of the other
    columns those named in ``carry`` come along.  Texts are read in runs of about 1 MB, but a
    single longer text is one run, for which a task holds about 60 bytes a byte.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    trust = trusted_ids(labels)
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 1
    # the fold of both sides, so that a join that moves texts moves this half only
    training = docs.select("doc_id", "text").filter(~held_out)
    model = stored(train(count_runs(training, trust.filter(~held_out))), "model")
    told = stored(perplexities(docs, model, carry), "perplexities")
    known = told.join(trust.filter(held_out), "doc_id", "left_semi").filter("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
    # one row a language; grouped by both null and set ones
    by_lang = known.filter("lang is not null").groupBy("lang").agg(at, F.count("*").alias("held"))
    overall = F.lit(known.agg(at).first()[0]).cast("double")
    enough = F.col("held") * (1 - quantile) >= 1 - 1e-9
    least = F.when(enough, F.col("threshold")).otherwise(F.greatest("threshold", overall))
    # a row a language; where the text says nothing of how many there are, Spark would deal rows by lang
    n_langs = (by_lang := stored(by_lang, "thresholds")).count()
    judged = told.join(F.broadcast(by_lang) if n_langs <= MOST_LANGS else by_lang, "lang", "left").withColumn("threshold", least * F.exp(F.lit(slack) / F.greatest("n_bytes", F.lit(1))))
    fine = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "perplexity", "threshold", fine.alias("kept"), *carry)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns.

    Rows are told apart by doc_id, lang and text, nulls included, so rows that share a doc_id, or
    have none, are each kept or not by their own text.
    """
    names = ("doc_id", "lang", "text")
    keyed = docs.withColumn("_row", F.xxhash64(*names, *(F.col(c).isNull() for c in names)))
    kept = classify(keyed, labels, carry=("_row",), **options).filter("kept").select("_row").distinct()
    return keyed.join(stored(kept, "kept"), "_row", "left_semi").drop("_row")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classify`` over all ``documents`` by all ``labels``: doc_id, lang, perplexity, threshold, kept."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
