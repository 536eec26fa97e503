"""Operator 8: remove word windows that an earlier document holds, behind a count-min sketch.

Pass 1 sketches.  Every window of 50 words is stood for by the least hash among the
runs of 25 words in it; equal windows have equal stand-ins, so what a sketch says of
the stand-in can only be too high for the window.  Each task sketches its own documents
and the partitions' sketches are added up, shard by shard.

Pass 2 emits the windows whose estimate is two or more and groups these exactly: a
window is removed where a smaller doc_id holds it.  No repeated window is lost; what the
sketch lets through for nothing, the grouping drops.

Windows are told apart by a 128-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, grams, signed, slices, stored, table, utf8, words
from .sketch import Marks, keeping, key_filter, octets, rows_in, sketch

WINDOW = 50
_SECOND = 0xA0761D6478BD642F


def _sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if n > width else h


def stand_ins(h: np.ndarray, off: np.ndarray, window: int):
    """For each window the least hash among its half-windows; returns them and the windows' first words."""
    half = (window + 1) // 2
    g, _ = grams(h, np.array([0, len(h)]), half)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(h))
    at = np.flatnonzero(left >= window)
    if not len(at):
        return np.zeros(0, np.uint64), at
    return _sliding_least(g, window - half + 1)[at], at


def sketch_windows(docs: DataFrame, window: int = WINDOW) -> Marks:
    """Marks of the stand-ins seen twice or more."""

    def values(batch):
        buf, off = utf8(batch.column(0))
        found = [np.zeros(0, np.uint64)]
        for a, b in slices(off):
            h, _, _, rows = words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            v, at = stand_ins(h, rows, window)
            row = np.searchsorted(rows, at, "right")
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
            found.append(v[new])
        return np.concatenate(found)

    half = (window + 1) // 2
    return sketch(docs.select("text"), values, octets(docs) / 6 * 2 / (window - half + 2), 2)


def earlier_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of ``docs`` (doc_id, key, text) that a smaller doc_id holds: key, doc_id, at (their first words, array)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch_windows(docs, window))

    def emit(batches):
        for batch in batches:
            buf, off = utf8(batch.column(2))
            ids, keys = batch.column(0), batch.column(1)
            for a, b in slices(off):
                h, _, _, rows = words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                v, at = stand_ins(h, rows, window)
                at = at[shared.value.may_hold(v)]
                if not len(at):
                    continue
                # both hashes are of whole windows; only those kept are looked up
                own = np.searchsorted(rows, at, "right") - 1
                first, where = grams(h, rows, window)
                second, _ = grams(h, rows, window, _SECOND)
                pick = np.searchsorted(where, at)
                take = pa.array(own + a)
                yield pa.RecordBatch.from_arrays([pa.array(signed(first[pick])), pa.array(signed(second[pick])), ids.take(take), keys.take(take), pa.array((at - rows[own]).astype(np.int32))], ["h1", "h2", "doc_id", "key", "at"])

    held = docs.filter("doc_id is not null").select("doc_id", "key", "text").mapInArrow(emit, "h1 long, h2 long, doc_id long, key long, at int")
    # written, so that the join is of two plain exchanges: Spark splits the partition of a very frequent window
    first = stored(held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "first")
    late = held.join(first, ["h1", "h2"]).filter("first < doc_id")
    return late.groupBy("doc_id", "key").agg(F.collect_list("at").alias("at"))


def drop_earlier_windows(docs: DataFrame, window: int = WINDOW, text: bool = True) -> DataFrame:
    """Remove every word of ``docs`` (doc_id, text) covered by a window that a smaller doc_id holds too.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)
    and, with ``text``, the kept text.  Windows are judged on the input.  Words are
    separated by ASCII white space and taken as they are; null text has none.  A
    document of less than ``window`` words keeps all.  Rows that share a doc_id are
    not earlier than each other; a null doc_id is neither earlier nor later than any.
    Other columns are ignored; each row gives one row.  A text is held whole by one task, with
    some 60 bytes a byte of it while it is cut in words.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    spans = stored(earlier_windows(docs, window), "spans")
    # texts that lose nothing need not move to learn so
    marks = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "key"))
    touched = rows_in(docs, "key", marks)
    same = touched.doc_id.eqNullSafe(spans.doc_id) & (touched.key == spans.key)
    told = touched.join(spans, same, "left").select(touched.doc_id, "text", "at")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            data = buf.tobytes()
            spans_of = batch.column(2)
            n_words, n_removed, digests, kept = [], [], [], []
            for a, b in slices(off):
                base = off[a]
                _, start, end, rows = words(buf[base : off[b]], off[a : b + 1] - base)
                for i in range(a, b):
                    first, last = rows[i - a], rows[i - a + 1]
                    keep = np.arange(first, last)
                    if spans_of[i].is_valid:
                        at = np.asarray(spans_of[i].values)
                        edge = np.zeros(last - first + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, np.minimum(at + window, last - first), -1)
                        keep = keep[np.cumsum(edge)[:-1] == 0]
                    line = b" ".join([data[s:e] for s, e in zip((start[keep] + base).tolist(), (end[keep] + base).tolist())])
                    n_words.append(last - first)
                    n_removed.append(last - first - len(keep))
                    digests.append(hashlib.sha256(line).hexdigest())
                    if text:
                        kept.append(line.decode())
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.string())] * text, [p.split()[0] for p in schema.split(", ")])

    def untouched(batches):
        for batch in keeping(batches, "key", marks.value, False):
            nothing = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield from run([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), nothing], ["doc_id", "text", "at"])])

    return told.mapInArrow(run, schema).unionByName(docs.mapInArrow(untouched, schema))


def op8_drop_earlier_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``drop_earlier_windows`` over all ``documents`` with windows of 50 words: doc_id, n_words, n_removed, kept_sha256."""
    return drop_earlier_windows(table(spark, sf_dir, "documents"), text=False)
