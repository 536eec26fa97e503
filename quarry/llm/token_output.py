"""Operator 5: encode documents and keep their ids in compressed token files."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, return_memory, stored, table
from .token_file import frame_index, frame_size, read_frames, write_frames

#: Characters of text that one file is meant to hold; of small inputs as many files as there are shuffle partitions hold this least at least.
FILE_CHARS, LEAST_CHARS = 32 << 20, 1 << 20
#: Ids of a frame (a frame ends with the document that reaches it) and of the frames coded together.
FRAME_IDS = 1 << 19
TOGETHER_IDS = 4 << 20
#: Words that a worker keeps encoded.
CACHE_WORDS = 1 << 18
#: Words given to the tokenizer at a time; its results take far more memory than their ids.
WORDS_AT_ONCE = 1 << 13


class WordEncoder:
    """Encodes texts with a tokenizer whose ids never span ASCII white space.

    Each different word is encoded once, and of new words each different
    pre-token; texts are put together from the words' ids by array operations.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"\s", *special]))
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.ids, self.off = np.zeros(0, np.int32), [0]

    def _one_by_one(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _coded(self, words: list[str]) -> list[list[int]]:
        """Ids of words: normalised and pre-tokenised as one text, its pre-tokens encoded by the model.

        Words that hold other white space or a special token would shift that, and go one by one.
        """
        plain = [w for w in words if not self.odd.search(w)]
        text = self.tokenizer.normalizer.normalize_str(" ".join(plain))
        if not plain or text.count(" ") != len(plain) - 1:
            return self._one_by_one(words)
        starts = np.cumsum([0] + [len(w) + 1 for w in text.split(" ")[:-1]])
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        owner = np.searchsorted(starts, [span[0] for _, span in found], "right") - 1
        coded: list[list[int]] = [[] for _ in plain]
        pieces, tokenize = self.pieces, self.tokenizer.model.tokenize
        for k, (piece, _) in zip(owner.tolist(), found):
            ids = pieces.get(piece)
            if ids is None:
                ids = pieces[piece] = [t.id for t in tokenize(piece)]
            coded[k] += ids
        if len(plain) == len(words):
            return coded
        rest = iter(self._one_by_one([w for w in words if self.odd.search(w)]))
        own = iter(coded)
        return [next(rest) if self.odd.search(w) else next(own) for w in words]

    def _learn(self, unique: list[str]) -> np.ndarray:
        if len(self.known) + len(unique) > CACHE_WORDS:
            self._clear()
        new = [w for w in unique if w not in self.known]
        added = [self.ids]
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            coded = self._coded(part)
            self.known.update(zip(part, range(len(self.off) - 1, len(self.off) - 1 + len(part))))
            added.append(np.fromiter(itertools.chain.from_iterable(coded), np.int32))
            self.off += (self.off[-1] + np.cumsum([len(ids) for ids in coded])).tolist()
        self.ids = np.concatenate(added)
        return np.fromiter((self.known[w] for w in unique), np.int64, len(unique))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of the texts in them."""
        return_memory()
        lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        word = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        off = np.asarray(self.off, np.int64)
        n = off[word + 1] - off[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(ends[-1]) + np.repeat(off[word] - ends[:-1], n)
        rows = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return self.ids[take], ends[rows]


def _write(path: str, end_id: int, n_ids: int):
    """Frames (value) of a partition's texts, in their order."""

    def run(batches):
        encoder, frames, docs, names, size, pending = WordEncoder(path), [], [], [], 0, 0

        def coded():
            return_memory()
            value = pa.array(write_frames(frames, n_ids), pa.binary())
            frames.clear()
            return pa.RecordBatch.from_arrays([value], ["value"])

        for batch in batches:
            ids, off = encoder.encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                names.append(doc_id)
                docs.append(np.append(ids[a:b], np.int32(end_id)))
                size += b - a + 1
                if size >= FRAME_IDS:
                    frames.append((names, docs))
                    pending, names, docs, size = pending + size, [], [], 0
                    if pending >= TOGETHER_IDS:
                        yield coded()
                        pending = 0
        if names:
            frames.append((names, docs))
        if frames:
            yield coded()
        # the worker lives on, beside others
        del encoder, frames, docs
        return_memory()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, n_ids: int, folder: str | None = None) -> str:
    """Write ``docs`` (doc_id, text) as token files in ``folder``, a new one in the shared folder if not given; returns it.

    A file is a run of frames (``token_file`` has their layout), each followed by a line feed; files, by
    the number in their names, and the frames in them follow ascending ``doc_id``, null first.
    Null text counts as empty, so a document has its end id at least; other columns are ignored;
    rows that repeat a ``doc_id`` are each kept, in an order that depends on their texts only.  Frames are
    self-contained and checksummed.  A task holds ``TOGETHER_IDS`` ids and the text
    at hand, however long.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    files = max(chars // FILE_CHARS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // LEAST_CHARS)) + 1
    # ids may be few or repeat; with the text's hash behind them files stay of a size
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(int(files), *order).sortWithinPartitions(*order, "text")
    folder = folder or new_path(spark, "tokens")
    frames = dealt.mapInArrow(_write(tokenizer_path, end_id, n_ids), "value binary")
    # Spark's writer of lines writes the bytes as they are, and a line feed behind each row
    frames.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", "\n").text(folder)
    return folder


def open_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder``: file_no and content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("file_no"), "content")


def _frames_of(content: bytes):
    """The frames of a file."""
    at = 0
    while at < len(content):
        end = at + frame_size(content, at)
        yield content[at:end]
        at = end + 1


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files of ``folder``: doc_id, start, n_tokens, ids_crc32 and ids (little-endian u32) per document.

    ``start`` counts the ids of all documents before.  A damaged frame fails the task.  A task holds a file.
    """
    bounded_batches(spark)
    files = open_token_files(spark, folder)

    def count(batches):
        for batch in batches:
            n = [sum(int(frame_index(f)["n"].sum()) for f in _frames_of(raw)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["file_no", "n"])

    sizes = stored(files.mapInArrow(count, "file_no long, n long"), "sizes")  # a row a file
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("file_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")), "starts")
    placed = files.join(starts, "file_no").select("before", "content")

    def run(batches):
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for frames in _together(raw):
                    return_memory()
                    for index, ids in read_frames(frames):
                        off = np.concatenate([[0], np.cumsum(index["n"], dtype=np.int64)])
                        data = ids.astype("<u4").tobytes()
                        parts = [data[4 * i : 4 * j] for i, j in zip(off[:-1], off[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(index["id"], pa.int64(), mask=index["has"] == 0),
                                pa.array(start + off[:-1], pa.int64()),
                                pa.array(np.diff(off), pa.int64()),
                                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                                pa.array(parts, pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )
                        start += int(off[-1])
        return_memory()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _together(content: bytes):
    """Frames of a file, as many at a time as are decoded in one go."""
    frames, size = [], 0
    for f in _frames_of(content):
        frames.append(f)
        size += int(frame_index(f)["n"].sum())
        if size >= TOGETHER_IDS:
            yield frames
            frames, size = [], 0
    if frames:
        yield frames


def index_of(frame: bytes) -> list[tuple[int | None, int]]:
    """(doc_id, length) of each document of a frame, without decoding its blocks."""
    return [(int(r["id"]) if r["has"] else None, int(r["n"])) for r in frame_index(frame)]


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token files (null text: end id only) and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, n_ids=49408)
    return read_token_files(spark, folder).drop("ids")
