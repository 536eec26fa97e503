"""Helpers that the operators of this package share.

Rows reach Python as Arrow record batches.  Text is handled as one byte buffer
with offsets per batch, so that no Python object is made per word or byte.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word, as a Java character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Bytes of one Arrow batch, whatever the length of its texts.
BATCH_BYTES = 8 << 20


_libc = None


def return_memory() -> None:
    """Give what is free back to the system; called once a batch, in Python workers only.

    Idle workers stay alive and would keep what they once needed, and several
    of them share an executor's memory.
    """
    global _libc
    if TaskContext.get() is None:  # the driver's allocator is the caller's
        return
    if _libc is None:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.mallopt(-3, 1 << 25)  # fixed values: M_MMAP_THRESHOLD; arrays up to 32 MB reuse the heap
            _libc.mallopt(-8, 2)  # M_ARENA_MAX
        except (OSError, AttributeError):  # another C library
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Spark hands to Python; a smaller bound of the caller's stays.

    The setting is read when a plan runs, which may be after the operator has returned;
    so all operators set the same value, and none sets a number of rows.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name) or ""
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local one is set if all runs on this machine; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "quarry-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is not yet in use; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, read it back.

    Unlike a local checkpoint the rows survive the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, which nothing reads any more."""
    files, where = _file_system(df.sparkSession, df._stored_at)
    files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    return_memory()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = 1 << 20):
    """Cut rows into runs of about ``limit`` bytes: (first row, row after)."""
    at, n = 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_WORD_BASE = 0x9E3779B97F4A7C55
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, off: np.ndarray):
    """Split rows at blanks.

    Returns hash, first byte and end byte of every word, and the offsets of the
    rows in words.  A word's hash depends on its bytes alone.
    """
    n = len(off) - 1
    if not len(buf):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    solid = ~_BLANK[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = off[:-1][off[:-1] < len(buf)]
    begins[firsts] = solid[firsts]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    run = np.add.reduceat(solid, start, dtype=np.int64)
    end = start + run
    place = np.arange(len(buf), dtype=np.int64)
    place[: start[0]] = 0
    place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(buf))))
    scale = powers(_WORD_BASE, int(place.max()) + 1)
    value = scale[place] * (buf.astype(np.uint64) + np.uint64(1))
    value[~solid] = 0
    h = mix(np.add.reduceat(value, start) + run.astype(np.uint64))
    return h, start, end, np.searchsorted(start, off).astype(np.int64)


def grams(h: np.ndarray, off: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93):
    """Hash of the n consecutive items from every item on.

    Returns hashes and the indices of the items where a gram starts that lies
    wholly within its row.
    """
    total = len(h)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(total)
    at = np.flatnonzero(left >= n)
    if not len(at):
        return np.zeros(0, np.uint64), at
    up = powers(base, total + 1)
    down = powers(pow(base, -1, 1 << 64), total + 1)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(base)) * up[:total], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * down[at]), at


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 seen as int64, for Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x


def row_key(*names: str):
    """A hash of columns that is the same on every run, nulls included."""
    return F.xxhash64(*names)
