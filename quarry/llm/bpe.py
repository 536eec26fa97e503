"""Operator 10: byte-level BPE encoding by overlapping chunks, and decoding.

Texts are cut into chunks that overlap.  Each chunk is pre-tokenised from its own
start, in parallel.  Pre-token boundaries depend only on what follows them, so two
scans that share one boundary agree from there on: neighbouring chunks are stitched
at the first boundary that both see in their overlap.  The pieces between stitches
are encoded, again in parallel, and their ids put together.  A stitch never follows
white space, since only runs of it look past their end.  Where two chunks share no
boundary (one pre-token longer than the overlap) they stay one piece.

Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Characters of a chunk, and by how many it reaches into the next.
CHUNK = 32_768
OVERLAP = 512


Then = tuple[Callable, str]


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=1)
def _coder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=1)
def _pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def _encode(coder, text: str, pattern: str) -> list[int]:
    try:
        return coder.encode_ordinary(text)
    except BaseException as e:  # a panic of its engine is no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        # its regex engine gives up on extremely long runs; pre-token by pre-token it need not look
        return [i for m in regex.finditer(pattern, text) for i in coder._encode_single_piece(m[0])]


def _packed(parts: list[list[int]]) -> pa.Array:
    return pa.array([np.asarray(p, "<u4").tobytes() for p in parts], pa.binary())


def boundaries(text: str, pattern: str, last: bool) -> np.ndarray:
    """Where pre-tokens begin in ``text`` (and its end, if ``last``).

    Unless it is the last chunk, a pre-token that touches the end may go on behind it.
    """
    ends = np.fromiter((m.end() for m in regex.finditer(pattern, text)), np.int64)
    ends = np.concatenate([[0], ends])
    return ends if last else ends[ends < len(text)]


def stitches(spans: list[tuple[np.ndarray, np.ndarray]]) -> list[int | None]:
    """Where each chunk but the first is stitched to the one before.

    ``spans``: per chunk the boundaries seen in its head overlap and in its tail
    overlap, that is the next chunk's head.  A chunk that could not be stitched
    is no longer known to agree with a scan of the whole text, so none follows it.
    """
    out: list[int | None] = []
    sure = True
    for (_, tail), (head, _) in zip(spans, spans[1:]):
        both = np.intersect1d(tail, head)
        sure = sure and len(both) > 0
        out.append(int(both[0]) if sure else None)
    return out


def encode_bpe(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, then: Then | None = None) -> DataFrame:
    """Ids of whole texts: doc_id, ids (little-endian u32).

    ``then`` (a generator over batches of these, and its schema) goes on in the same worker, as ids would else pass through the JVM.

    ``docs`` has doc_id and text; null text is empty, other columns are ignored.  No
    special tokens.  Every row gives one row, also where rows repeat.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long_text = F.length("text") > chunk

    def whole(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed([_encode(coder, t, pattern) for t in batch.column(1).to_pylist()])], ["doc_id", "ids"])

    go_on, schema = then or ((lambda batches: batches), "doc_id long, ids binary")
    short = docs.filter(~long_text).mapInArrow(lambda batches: go_on(whole(batches)), schema)

    # A text is known by its doc_id and hashes; rows that agree in all of them are equal and go together.
    key = ["doc_id", "h1", "h2"]
    n = F.ceil(F.length("text") / chunk).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_no"), (i == n - 1).alias("last"), F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)).alias("part")))
    parts = docs.filter(long_text).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}).select(*key, F.explode(starts).alias("c")).select(*key, "c.*")
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key, "chunk_no")

    def scan(batches):
        for batch in batches:
            heads, tails = [], []
            for part, last in zip(batch.column("part").to_pylist(), batch.column("last").to_pylist()):
                at = boundaries(part, pattern, last)
                at = at[[i == 0 or not part[i - 1].isspace() for i in at]] if len(at) else at
                heads.append(at[at < overlap])
                tails.append(at[at >= chunk] - chunk)
            own = [batch.column(k) for k in (*key, "chunk_no")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*key, "chunk_no", "head", "tail"])

    seen = parts.mapInArrow(scan, "doc_id long, h1 long, h2 long, chunk_no int, head array<long>, tail array<long>")

    def stitch(group: pa.Table) -> pa.Table:
        numbers = group.column("chunk_no").to_numpy()
        _, first = np.unique(numbers, return_index=True)
        heads, tails = (group.column(c).take(first).to_pylist() for c in ("head", "tail"))
        cuts = [0, *stitches([(np.asarray(h, np.int64), np.asarray(t, np.int64)) for h, t in zip(heads, tails)])]
        rows, piece = [], -1
        for i, cut in enumerate(cuts):
            piece += cut is not None
            follows = cuts[i + 1] if i + 1 < len(cuts) else None
            # from where to where the chunk is the piece's: up to the stitch, or to the next chunk's begin
            rows.append((i, piece, cut or 0, chunk + (follows or 0)))
        one = {k: group.column(k).slice(0, 1).take([0] * len(rows)) for k in key}
        cols = list(zip(*rows))
        return pa.table(one | {"chunk_no": pa.array(cols[0], pa.int32()), "piece": pa.array(cols[1], pa.int32()), "first": pa.array(cols[2], pa.int32()), "end": pa.array(cols[3], pa.int32()), "copies": pa.array([int((numbers == 0).sum())] * len(rows), pa.int32())})

    keys = "doc_id long, h1 long, h2 long"
    plan = seen.groupBy(*key).applyInArrow(stitch, f"{keys}, chunk_no int, piece int, first int, end int, copies int")
    same = (parts.doc_id.eqNullSafe(plan.doc_id)) & (parts.h1 == plan.h1) & (parts.h2 == plan.h2) & (parts.chunk_no == plan.chunk_no)
    placed = parts.join(plan, same).select(parts.doc_id, parts.h1, parts.h2, parts.chunk_no, "part", "piece", "first", "end", "copies")

    def encode(group: pa.Table) -> pa.Table:
        coder = _coder(path, pattern)
        _, at = np.unique(group.column("chunk_no").to_numpy(), return_index=True)
        own = group.take(at)
        text = "".join(p[f:e] for p, f, e in zip(*(own.column(c).to_pylist() for c in ("part", "first", "end"))))
        ids = _packed([_encode(coder, text, pattern)])
        return pa.table({k: own.column(k).slice(0, 1) for k in (*key, "piece", "copies")} | {"ids": ids})

    pieces = placed.groupBy(*key, "piece").applyInArrow(encode, f"{keys}, piece int, copies int, ids binary")

    def join(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("piece").to_numpy())
        ids = b"".join(group.column("ids").take(order).to_pylist())
        copies = group.column("copies")[0].as_py()
        rows = pa.table({"doc_id": group.column("doc_id").slice(0, 1).take([0] * copies), "ids": pa.array([ids] * copies, pa.binary())})
        return pa.Table.from_batches(list(go_on(rows.combine_chunks().to_batches())))

    return short.unionByName(pieces.groupBy(*key).applyInArrow(join, schema))


def decoder(path: str, text: bool = True) -> Then:
    """Decoding as a generator over batches of (doc_id, ids), with its schema."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded binary" * text

    def run(batches):
        table_ = _pieces(path)
        names = [str(i).encode() for i in range(len(table_))]
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                ids = np.frombuffer(raw, "<u4").tolist()
                decoded = b"".join([table_[i] for i in ids])
                out.append((len(ids), hashlib.sha256(b",".join([names[i] for i in ids])).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded))
            cols = list(zip(*out)) if out else [[], [], [], []]
            types = (pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols[: 3 + text], types))], [p.split()[0] for p in schema.split(", ")])

    return run, schema


def decode_bpe(encoded: DataFrame, path: str, text: bool = True) -> DataFrame:
    """Decode ``encoded`` (doc_id, ids): doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``text``, the bytes as decoded.

    ``ids_sha256`` is taken of the decimal ids joined by commas.
    """
    return encoded.select("doc_id", "ids").mapInArrow(*decoder(path, text))


def bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_bpe(docs, path, pattern, then=decoder(path, text=False))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bpe_digests`` of all ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(table(spark, sf_dir, "documents"))
