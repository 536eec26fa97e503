"""Operator 6: remove repeated byte strings, found by a Burrows-Wheeler transform built column by column.

A transform of a whole corpus is one sequence, and its rounds are as many as its longest
document has bytes.  So the corpus is first dealt to many small collections
that can be built apart:

1. The anchor of a 400-byte window is the 200-byte run of least hash in it (the first such).
   Equal windows have equal anchors at equal distance.  Neighbouring windows that share an
   anchor make a segment: their bytes, at most 600.
2. A count-min sketch of the anchors drops segments whose anchor occurs once.
3. Equal segments become one string with its number of occurrences.  Strings of one
   anchor make a collection, also if there is one only.  Its bytes are fetched from one document each.
4. A collection of more than ``GROUP_MOST`` strings is dealt anew, by the bytes that the
   windows of a quarter of the distances have in common, again and again, so that no
   task gets the contexts of a very frequent passage all together.
5. Every collection's transform and common prefixes are built (``bwt.build``): one symbol per
   string and round, the columns in files between the rounds.  A symbol is ``SYMBOL`` bytes; a segment gives
   a string for each phase in which one of its windows begins, so every window begins a suffix, and each row of
   the transform stands for as many suffixes as its segment occurs.  Rows that share 400 / ``SYMBOL``
   symbols with a neighbour, or stand for two suffixes or more, are repeated windows; nothing else decides that.

Segments and symbols are told apart by 64-bit hashes (segments by two: of anchor and content).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .bwt import build
from .common import bounded_batches, mix, powers, signed, slices, stored, table, utf8
from .shingle_join import _grouped
from .sketch import Marks, keeping, key_filter, octets, rows_in, sketch
from .substring import _sliding_least

WINDOW = 400
SYMBOL = 50
#: Strings that a collection may have.
GROUP_MOST = 2048
#: Distances that share a part when a collection is dealt anew, level by level; at 1 the part is the window.
LEVELS = (51, 13, 4, 1)
#: Bytes of collections that are built in one go, and of parts that are handed on at a time.
TOGETHER = 1 << 17
HANDED_ON = 4 << 20
_BASE = 0x9E3779B97F4A7C55
_PLACE = np.uint64(0xFFFFFFFF)


class _Runs:
    """Hashes of byte runs of any length: differences of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.down = powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.sums[1:])

    def of(self, first, length):
        length = np.asarray(length)
        return mix((self.sums[first + length] - self.sums[first]) * self.down[first] + length.astype(np.uint64))

    def all(self, length):
        return mix((self.sums[length:] - self.sums[: len(self.sums) - length]) * self.down[: len(self.sums) - length])


def segments(data: np.ndarray, off: np.ndarray, window: int = WINDOW):
    """Segments of texts: first byte, number of windows, distance of the anchor, hash of the anchor, and the run hashes."""
    half, runs = window // 2, _Runs(data)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))
    at = np.flatnonzero(left >= window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), runs
    anchors = runs.all(half)
    # the hash's upper half, then the place: the least is the first of the smallest
    packed = (anchors & ~_PLACE) | np.arange(len(anchors), dtype=np.uint64)
    anchor = (_sliding_least(packed, window - half + 1)[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start, where = at[first], anchor[first]
    return start, np.diff(np.append(first, len(at))), where - start, anchors[where], runs


def pieces(data: np.ndarray, off: np.ndarray, window: int, limit: int = 1 << 20):
    """Runs of rows of about ``limit`` bytes, longer rows cut such that each window lies in one piece: bytes, offsets, first row, first byte in it."""
    for a, b in slices(off, limit):
        size = off[b] - off[a]
        if b - a > 1 or size <= 2 * limit:
            yield data[off[a] : off[b]], off[a : b + 1] - off[a], a, 0
            continue
        for at in range(0, int(size), limit):
            part = data[off[a] + at : min(off[a] + at + limit + window - 1, off[b])]
            yield part, np.array([0, len(part)]), a, at


def sketch_anchors(docs: DataFrame, window: int) -> Marks:
    def values(batch):
        data, off = utf8(batch.column(0))
        return np.concatenate([np.zeros(0, np.uint64), *(segments(part, rows, window)[3] for part, rows, _, _ in pieces(data, off, window))])

    return sketch(docs.select("text"), values, octets(docs) * 2 / (window - window // 2 + 2), 2)


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """Segments of ``docs`` (doc_id, key, text) whose anchor may occur twice: g, c, doc_id, key, at, windows, anchor."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch_anchors(docs, window))

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(2))
            for part, rows, a, shift in pieces(data, off, window):
                start, n, distance, g, runs = segments(part, rows, window)
                keep = np.flatnonzero(shared.value.may_hold(g))
                start, n, distance, g = start[keep], n[keep], distance[keep], g[keep]
                row = np.searchsorted(rows, start, "right") - 1
                c = runs.of(start, n + window - 1) ^ mix(distance.astype(np.uint64))
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(g)), pa.array(signed(c)), batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (start - rows[row] + shift, n, distance))],
                    ["g", "c", "doc_id", "key", "at", "windows", "anchor"],
                )

    found = stored(docs.select("doc_id", "key", "text").mapInArrow(run, "g long, c long, doc_id long, key long, at int, windows int, anchor int"), "segments")
    shared.unpersist()
    return found


def _fetch(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of ``wanted`` (g, c, n, windows, anchor, rep: struct of key, at)."""
    wanted = wanted.select("rep.key", F.struct("rep.at", "g", "c", "n", "windows", "anchor").alias("s"))
    lists = stored(wanted.groupBy("key").agg(F.collect_list("s").alias("s")), "wanted")  # at most a document's segments each
    touched = rows_in(docs.select("key", "text"), "key", docs.sparkSession.sparkContext.broadcast(key_filter(lists, "key")))

    def cut(batches):
        for batch in batches:
            data, off = utf8(batch.column(0))
            lists_ = batch.column(1)
            flat = lists_.flatten()
            at, g, c, n, windows, anchor = (flat.field(k) for k in range(6))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists_.value_lengths()))
            first = off[row] + at.to_numpy()
            raw = data.tobytes()
            parts = [raw[f : f + w] for f, w in zip(first.tolist(), (windows.to_numpy() + window - 1).tolist())]
            yield pa.RecordBatch.from_arrays([g, c, n, windows, anchor, pa.array(parts, pa.binary())], ["g", "c", "n", "windows", "anchor", "bytes"])

    return touched.join(lists, "key").select("text", "s").mapInArrow(cut, "g long, c long, n long, windows int, anchor int, bytes binary").dropDuplicates(["g", "c"])


def _deal_anew(strings: DataFrame, width: int, window: int) -> DataFrame:
    """Parts of strings, by ``width`` distances: like strings, with whose part it is (of_g, of_c) and from which window on."""

    def run(batches):
        for batch in batches:
            g, c, n, windows, anchor = (batch.column(k).to_numpy() for k in range(5))
            out, size = [], 0
            for k, raw in enumerate(batch.column(5)):
                raw = raw.as_py()
                data = np.frombuffer(raw, np.uint8)
                runs, far = _Runs(data), int(anchor[k])
                # window i lies anchor - i before its anchor
                for m in range((far - int(windows[k]) + 1) // width, far // width + 1):
                    first, last = max(0, far - (m * width + width - 1)), min(int(windows[k]) - 1, far - m * width)
                    core = far - m * width
                    common = runs.of(np.array([core]), np.array([window - width + 1]))[0]
                    part = raw[first : last + window]
                    of_part = runs.of(np.array([first]), np.array([len(part)]))[0]
                    with np.errstate(over="ignore"):
                        key = mix(np.array([common + np.uint64(m * len(LEVELS) + width)]))[0]
                        name = of_part ^ mix(np.array([far - first + 1], np.uint64))[0]
                    out.append((int(key.view(np.int64)), int(name.view(np.int64)), int(n[k]), last - first + 1, far - first, part, int(g[k]), int(c[k]), first))
                    size += len(part) + 400
                if size >= HANDED_ON:
                    yield handed_on(out)
                    out, size = [], 0
            if out:
                yield handed_on(out)

    def handed_on(out):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["g", "c", "n", "windows", "anchor", "bytes", "of_g", "of_c", "shift"])

    return strings.select("g", "c", "n", "windows", "anchor", "bytes").mapInArrow(run, "g long, c long, n long, windows int, anchor int, bytes binary, of_g long, of_c long, shift int")


def symbols(data: np.ndarray, width: int) -> np.ndarray:
    """Ranks (from 1, in no particular order) of the ``width`` bytes from each byte on; equal if their 64-bit hashes are."""
    if len(data) < width:
        return np.zeros(0, np.int64)
    return pd.factorize(_Runs(data).all(width))[0].astype(np.int64) + 1


def repeated_windows(parts: list[bytes], windows: np.ndarray, often: np.ndarray, window: int = WINDOW, symbol: int = SYMBOL, on_disk: bool = False):
    """Which windows of the strings ``parts`` occur elsewhere: strings, first windows, windows after; a row per run of them.

    ``often``: how many occurrences each string has.  Builds one transform over all of them,
    in which a string stands for its occurrences: a suffix occurs elsewhere if it shares a
    window with a neighbour in the transform, or if the rows that are its own stand for two or more.
    """
    size = np.array([len(p) for p in parts])
    base = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(parts), np.uint8)
    windows = np.asarray(windows, np.int64)
    # a string for each phase in which a window begins
    phases = np.minimum(symbol, windows)
    part = np.repeat(np.arange(len(parts)), phases)
    phase = np.arange(len(part)) - np.repeat(np.cumsum(phases) - phases, phases)
    first, count = base[part] + phase, (size[part] - phase) // symbol
    cuts = np.concatenate([[0], np.cumsum(count)])
    where = np.repeat(first - symbol * cuts[:-1], count) + symbol * np.arange(cuts[-1])
    columns = build(symbols(data, symbol)[where], cuts, window // symbol, on_disk)
    # rows of suffixes that hold a window; neighbours that share one are one run of equal windows
    again = columns["lcp"] >= window // symbol
    own = np.append(where, len(data))[columns["name"]]
    times = np.append(np.repeat(np.asarray(often)[part], count), 0)[columns["name"]]
    run = np.cumsum(~again) - 1
    repeated = np.bincount(run, times)[run] > 1
    hit = np.zeros(len(data) + 1, bool)
    hit[own[repeated]] = True
    # only places that begin a window; the gap byte keeps strings apart
    begins = np.zeros(len(data) + len(parts) + 1, np.int8)
    at = np.arange(len(data)) - np.repeat(base[:-1], size)
    begins[np.arange(len(data)) + np.repeat(np.arange(len(parts)), size)] = hit[:-1] & (at < np.repeat(windows, size))
    edges = np.diff(begins, prepend=0)
    a, b = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    k = np.searchsorted(base + np.arange(len(base)), a, "right") - 1
    return k, a - base[k] - k, b - base[k] - k


def _built(strings: DataFrame, window: int, symbol: int) -> DataFrame:
    """(g, c, first, last): repeated windows of ``strings``, whose collections are all within bounds."""
    spark = strings.sparkSession
    dealt = strings.select("g", "c", "n", "windows", "bytes").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g", "c")

    def check(t, starts):
        size = np.cumsum(np.append(0, np.diff(utf8(t.column("bytes"))[1])))
        g, c, n, windows = (t.column(k).to_numpy() for k in ("g", "c", "n", "windows"))
        at, rows = 0, []
        while at < len(starts) - 1:
            # whole collections up to the bound; their suffixes sort into one transform
            to = int(np.searchsorted(size[starts], size[starts[at]] + TOGETHER, "right")) - 1
            to = min(len(starts) - 1, max(to, at + 1))
            a, b = starts[at], starts[to]
            k, first, last = repeated_windows(t.column("bytes").slice(a, b - a).to_pylist(), windows[a:b], n[a:b], window, symbol, on_disk=True)
            rows.append((g[a + k], c[a + k], first, last))
            at = to
        cols = [np.concatenate(x) for x in zip(*rows)]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["g", "c", "first", "last"])

    return dealt.mapInArrow(_grouped(check, 1), "g long, c long, first int, last int")


def repeats(docs: DataFrame, window: int = WINDOW, symbol: int = SYMBOL, group_most: int = GROUP_MOST) -> DataFrame:
    """Repeated windows of ``docs`` (doc_id, key, text): doc_id, key, spans (array of first and last start)."""
    found = occurrences(docs, window)
    contents = found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("rep"), F.first("windows").alias("windows"), F.first("anchor").alias("anchor"))
    contents = stored(contents, "contents")

    def shared(strings):
        """Those whose anchor occurs twice or more; the anchors are written, so that Spark splits the partition of a frequent one."""
        groups = strings.groupBy("g").agg(F.sum("n").alias("total")).filter("total > 1").select("g")
        return strings.join(stored(groups, "anchors"), "g")

    results = []
    strings = stored(_fetch(docs, shared(contents), window), "strings")
    lineage = None
    for width in LEVELS:
        width = min(width, window - window // 2 + 1)
        groups = strings.groupBy("g").agg(F.count("*").alias("kinds"))
        hot = stored(groups.filter(F.col("kinds") > group_most).select("g"), "hot")
        back = (lambda df, of: df if of is None else df.join(of, ["g", "c"]).select(F.col("of_g").alias("g"), F.col("of_c").alias("c"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")))
        results.append(back(_built(strings.join(hot, "g", "left_anti"), window, symbol), lineage))
        if hot.isEmpty():
            strings = None
            break
        parts = stored(_deal_anew(strings.join(hot, "g"), width, window), "parts")
        step = parts.select("g", "c", "of_g", "of_c", "shift")
        if lineage is not None:
            older = lineage.select(F.col("g").alias("of_g"), F.col("c").alias("of_c"), F.col("of_g").alias("top_g"), F.col("of_c").alias("top_c"), F.col("shift").alias("more"))
            step = step.join(older, ["of_g", "of_c"]).select("g", "c", F.col("top_g").alias("of_g"), F.col("top_c").alias("of_c"), (F.col("shift") + F.col("more")).alias("shift"))
        lineage = stored(step, "lineage")
        # n adds up over the strings that have the part
        merged = parts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("anchor").alias("anchor"), F.first("bytes").alias("bytes"))
        strings = stored(shared(stored(merged, "merged")), "strings")
    if strings is not None:  # parts of one window: a collection holds equal ones only, unless hashes collide
        results.append(back(_built(strings, window, symbol), lineage))
    spans = results[0]
    for r in results[1:]:
        spans = spans.unionByName(r)
    # one row a string, so that an occurrence meets one: at most ``window`` runs each, joined where they touch
    runs = stored(spans.groupBy("g", "c").agg(_joined(F.array_sort(F.collect_list(F.struct("first", "last")))).alias("runs")), "windows")
    told = found.select("g", "c", "doc_id", "key", "at").join(runs, ["g", "c"])
    placed = F.transform("runs", lambda r: F.struct((F.col("at") + r["first"]).alias("a"), (F.col("at") + r["last"] - 1).alias("b")))
    return told.select("doc_id", "key", placed.alias("own")).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("own")).alias("spans"))


def _joined(runs: Column) -> Column:
    """Sorted runs (first, last: the window after) without those that touch."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def add(done, r):
        before = F.try_element_at(done, F.lit(-1))
        longer = F.struct(before["first"].alias("first"), F.greatest(before["last"], r["last"]).alias("last"))
        return F.when(before["last"] >= r["first"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, none, add)


def drop_repeats(
    docs: DataFrame, window: int = WINDOW, symbol: int = SYMBOL, group_most: int = GROUP_MOST, rest: bool = True, as_text: bool = False, carry: tuple[str, ...] = (), least_words: int = 0
) -> DataFrame:
    """Remove every byte of ``docs`` (doc_id, text) that a ``window``-byte string covers which starts elsewhere too.

    "Elsewhere" is any other place, also in the same document; windows are judged on the input
    and do not cross documents.  Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, with ``rest``, the remaining bytes or, with ``as_text``,
    their text, without characters that lost a byte.  Null text is
    empty; texts shorter than a window keep all.  Each row counts as a document of
    its own, also if it repeats another; a null doc_id is one like others.  Of the other columns those named in ``carry`` come along.
    With ``least_words`` only maximal runs of covered bytes that hold as many words are removed.
    Texts are searched in pieces of 1 MB; a text itself, its spans and the rest are held whole by one task.
    """
    bounded_batches(docs.sparkSession)
    carried = [docs.schema[c] for c in carry]
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), "text", *carry)
    keyed = docs.select("doc_id", F.col("_key").alias("key"), "text")
    spans = stored(repeats(keyed, window, symbol, group_most), "spans")
    marks = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "key"))
    touched = rows_in(docs, "_key", marks)
    same = touched.doc_id.eqNullSafe(spans.doc_id) & (touched._key == spans.key)
    told = touched.join(spans, same, "left").select(touched.doc_id, "text", "spans", *carry)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"][: 5 + rest]
    schema = StructType([*(StructField(n, t) for n, t in zip(names, (LongType(),) * 4 + (StringType(), StringType() if as_text else BinaryType()))), *carried])

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw, lists = data.tobytes(), batch.column(2)
            a, b = (lists.values.field(k).to_numpy() for k in range(2)) if len(lists.values) else (np.zeros(0, int),) * 2
            at = lists.offsets.to_numpy()
            out = []
            for i in range(batch.num_rows):
                text = raw[off[i] : off[i + 1]]
                removed = spans_ = 0
                if at[i + 1] > at[i]:
                    order = np.argsort(a[at[i] : at[i + 1]])
                    first, end = a[at[i] : at[i + 1]][order].astype(np.int64), b[at[i] : at[i + 1]][order].astype(np.int64) + window
                    end = np.maximum.accumulate(end)
                    new = np.append(True, first[1:] > end[:-1])
                    first, end = first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                    if least_words:
                        long = np.array([len(text[x:y].split()) >= least_words for x, y in zip(first.tolist(), end.tolist())])
                        first, end = first[long], end[long]
                    removed, spans_ = int((end - first).sum()), len(first)
                    text = b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*first.tolist(), len(text)]))
                out.append((off[i + 1] - off[i], removed, spans_, hashlib.sha256(text).hexdigest(), text.decode(errors="ignore") if as_text else text))
            cols = list(zip(*out)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols[: 4 + rest], types)), *batch.columns[3:]], [*names, *carry])

    def untouched(batches):
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in keeping(batches, "_key", marks.value, False):
            nothing = pa.array([[]] * batch.num_rows, kind)
            yield from run([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), nothing, *batch.columns[3:]], ["doc_id", "text", "spans", *carry])])

    return told.mapInArrow(run, schema).unionByName(docs.mapInArrow(untouched, schema))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``drop_repeats`` over all ``documents`` with strings of 400 bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return drop_repeats(table(spark, sf_dir, "documents"), rest=False)
