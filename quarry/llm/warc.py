"""Operator 7: write web archives, and read them by boundary-chain verification.

Reading does not trust the bytes ``WARC/1.`` alone: tasks emit a candidate for each
place that parses as a record's header, with the offset where its successor must
begin; pointer jumping from offset 0 then keeps the candidates that the chain of
records reaches.  A header quoted in a payload is a candidate, but not reached.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, stored, table
from .sketch import key_filter, rows_in

#: Payloads from this size on are stored once; copies become revisit records.
REVISIT_BYTES = 1000
#: An archive ends with the record that reaches this size.
ARCHIVE_BYTES = 4 << 20
#: The tables hold no capture times, and the format wants one.
DATE = "1970-01-01T00:00:00Z"
#: Bytes that one look for candidates spans.
CHUNK = 1 << 20

#: What ends a record.
_END = b"\r\n\r\n"
_URN = "<urn:page:%s>"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_URN % ('null' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_URN % refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archives(rows: DataFrame, archive_bytes: int, marks=None) -> DataFrame:
    """Archives (value) of ``rows``: page_id, url, payload, digest, first and _key, without those whose _key is not 0 and in ``marks``."""

    def run(batches):
        buffer, size = [], 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(buffer).removesuffix(_END)], pa.binary())], ["value"])
        for batch in batches:
            if marks:
                key = batch.column(5).to_numpy()
                batch = batch.filter(pa.array((key == 0) | ~marks.value.may_hold(key.view(np.uint64))))
            for page_id, url, payload, digest, first, _ in zip(*(c.to_pylist() for c in batch.columns)):
                buffer.append(_record(page_id, url, payload, digest, first, first is not None and page_id != first))
                size += len(buffer[-1])
                if size >= archive_bytes:
                    yield archive()
                    buffer, size = [], 0
        if buffer:
            yield archive()

    return rows.mapInArrow(run, "value binary")


def write_warc(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None, compression: str = "gzip") -> str:
    """Write ``pages`` (page_id, url, html) as WARC files, one archive a file, in ``folder``, a new one in the shared folder if not given; returns it.

    Files are compressed whole; ``compression`` "none" leaves them plain.

    Null html is an empty payload, a null url leaves its header out, other columns
    are ignored.  Of equal payloads of at least ``revisit_bytes`` that with the
    largest page_id is a response and the others are revisits; rows that share this
    largest page_id, and all rows if every page_id is null, are responses.  A task holds an
    archive and the payload that ends it, however long.

    Only payloads that may have a copy (a filter of their keys, at most 2 x 16 MB, is sent out)
    move to learn of it; short ones and the others are written where they are read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce("html", F.lit("")).cast("binary")
    told = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha1("payload"))
    told = told.withColumn("_key", F.when(F.octet_length("payload") >= revisit_bytes, F.xxhash64("digest", F.octet_length("payload")).bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    long = told.filter(F.octet_length("payload") >= revisit_bytes)
    copies = long.groupBy("digest", "_key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = stored(copies, "copies")
    marks = spark.sparkContext.broadcast(key_filter(copies, "_key"))
    alone = told.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("first"), "_key")
    # two plain exchanges, so that Spark splits the partition of a payload with many copies
    met = rows_in(long, "_key", marks).join(copies, ["digest", "_key"], "left").select("page_id", "url", "payload", "digest", "first", "_key")
    archives = _archives(alone, archive_bytes, marks).union(_archives(met, archive_bytes))
    # a row a file; what Spark's writer of lines puts behind a row is the end of the archive's last record
    folder = folder or new_path(spark, "warc")
    archives.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", _END.decode()).option("maxRecordsPerFile", 1).option("compression", compression).text(folder)
    return folder


def open_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder``, also those of other writers: archive_no (the path) and archive, as it lies there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(folder)
    return files.select(F.col("path").alias("archive_no"), F.col("content").alias("archive"))


def plain(archive: bytes) -> bytes:
    """An archive's bytes, whether it is compressed (in one member or one a record) or not."""
    return gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)


def candidates_in(archive: bytes, first: int, last: int):
    """(offset, end of header, offset of the successor) of each header that begins in [first, last)."""
    at = archive.find(b"WARC/1.", first, last + 6)
    while at >= 0:
        end = archive.find(b"\r\n\r\n", at)
        length = _LENGTH.search(archive, at, end + 2) if end >= 0 else None
        if length:
            after = end + 4 + int(length[1]) + 4
            if after <= len(archive):
                yield at, end + 4, after
        at = archive.find(b"WARC/1.", at + 1, last + 6)


def reached(offset: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping.

    Each round joins, for every marked candidate, the one its pointer leads to, and
    then doubles all pointers; after k rounds the first 2**k records are marked.
    """
    order = np.argsort(offset)
    sorted_offset = offset[order]
    n = len(offset)
    jump = np.searchsorted(sorted_offset, after[order])
    jump = np.where((jump < n) & (sorted_offset[np.minimum(jump, n - 1)] == after[order]), jump, n) if n else jump
    jump = np.append(jump, n)
    marked = np.zeros(n + 1, bool)
    marked[:1] = n > 0 and sorted_offset[0] == 0
    while True:
        count = marked[:n].sum()
        marked[jump[np.flatnonzero(marked)]] = True
        marked[n] = False
        if marked[:n].sum() == count:
            break
        jump = jump[jump]
    out = np.zeros(n, bool)
    out[order] = marked[:n]
    return out


def candidates(archives: DataFrame) -> DataFrame:
    """archive_no, offset, body, after for each parsed header of each archive."""

    def run(batches):
        for batch in batches:
            for number, archive in zip(batch.column(0).to_pylist(), batch.column(1)):
                archive = plain(archive.as_py())
                found = [c for at in range(0, max(len(archive), 1), CHUNK) for c in candidates_in(archive, at, min(at + CHUNK, len(archive)))]
                cols = np.asarray(found, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(cols), pa.string()), *(pa.array(cols[:, k], pa.int64()) for k in range(3))], ["archive_no", "offset", "body", "after"])

    return archives.select("archive_no", "archive").mapInArrow(run, "archive_no string, offset long, body long, after long")


def chain(found: DataFrame) -> DataFrame:
    """The records of each archive: archive_no, offsets and bodies (arrays)."""

    def run(group: pa.Table) -> pa.Table:
        offset, body, after = (group.column(k).to_numpy() for k in ("offset", "body", "after"))
        keep = np.flatnonzero(reached(offset, after))
        keep = keep[np.argsort(offset[keep])]
        return pa.table({"archive_no": group.column("archive_no").slice(0, 1), "offsets": pa.array([offset[keep]], pa.list_(pa.int64())), "bodies": pa.array([body[keep]], pa.list_(pa.int64()))})

    return found.groupBy("archive_no").applyInArrow(run, "archive_no string, offsets array<long>, bodies array<long>")


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(urn: str | None):
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ``archives`` (archive_no, archive).

    page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, and
    with ``payloads`` the payload (null for revisits).  A task holds an archive whole.  A response whose payload
    does not match its digest fails the task.  Bytes that the chain of records
    does not reach are no records, so an archive that begins with none has none.
    """
    bounded_batches(archives.sparkSession)
    chained = archives.join(chain(candidates(archives)), "archive_no").select("archive", "offsets", "bodies")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for archive, offsets, bodies in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                archive, rows = plain(archive.as_py()), []
                for at, body in zip(offsets, bodies):
                    head = _headers(archive[at : body - 4])
                    block = archive[body : body + int(head["content-length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload at {at} does not match its digest")
                    size = int(_headers(http)["content-length"]) if revisit else len(payload)
                    rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], _page(head.get("warc-refers-to")), None if revisit else payload)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), _TYPES)], names)

    return chained.mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC files and read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    return read_warc(open_warc(spark, write_warc(table(spark, sf_dir, "pages"))), payloads=False)
