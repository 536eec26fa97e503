"""Count-min sketches and key filters, built by tasks, added up shard by shard, bounded in size.

Both are rows of cells; what is sent to the tasks is one bit a cell: whether it was
counted ``often`` times or more.  A lookup can say yes for nothing, never no
for a value counted that often.  ``MOST_CELLS`` bounds the bits of a row (16 MB); beyond the
counts that it serves, more lookups say yes for nothing, and nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 2
LEAST_CELLS, MOST_CELLS = 18, 27  # log2
_SHARD = 18
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def cell_bits(values: float) -> int:
    """log2 of a row's cells for about so many values."""
    return min(MOST_CELLS, max(LEAST_CELLS, math.ceil(math.log2(max(4 * values, 1)))))


def _cells(v: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(v * np.uint64(odd)) >> np.uint64(64 - bits) for odd in _ODD]


class Marks:
    """Which cells were counted often enough."""

    def __init__(self, bits: int):
        self.bits = bits
        self.rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]

    def may_hold(self, v: np.ndarray) -> np.ndarray:
        """Whether each value (uint64) may have been counted often enough."""
        yes = np.ones(len(v), bool)
        for cells, row in zip(_cells(v, self.bits), self.rows):
            cells = cells.astype(np.int64)
            yes &= (row[cells >> 3] >> (7 - (cells & 7)) & 1).astype(bool)
        return yes


def sketch(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], expected: float, often: int) -> Marks:
    """Sketch the ``values`` (uint64) of each batch of ``rows``; mark the cells counted ``often`` times."""
    bits = cell_bits(expected)

    def part(batches):
        for batch in batches:
            out, v = [], values(batch)
            for d, cells in enumerate(_cells(v, bits)):
                cell, n = np.unique(cells, return_counts=True)
                shard = (cell >> np.uint64(_SHARD)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(cell) else np.zeros(0, int)
                for i, j in zip(edges[:-1], edges[1:]):
                    own = (cell[i:j] & np.uint64((1 << _SHARD) - 1)).astype("<u4")
                    out.append((d, int(shard[i]), own.tobytes(), np.minimum(n[i:j], often).astype("u1").tobytes()))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["d", "shard", "cells", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << _SHARD, np.int64)
        for cells, counts in zip(group.column("cells").to_pylist(), group.column("counts").to_pylist()):
            total[np.frombuffer(cells, "<u4")] += np.frombuffer(counts, "u1")
        return pa.table({"d": group.column("d").slice(0, 1), "shard": group.column("shard").slice(0, 1), "marks": pa.array([np.packbits(total >= often).tobytes()], pa.binary())})

    merged = rows.mapInArrow(part, "d int, shard long, cells binary, counts binary").groupBy("d", "shard").applyInArrow(add, "d int, shard long, marks binary")
    marks = Marks(bits)
    for d, shard, raw in merged.collect():  # DEPTH * 2**bits bits in all
        marks.rows[d][shard << _SHARD >> 3 :][: len(raw)] = np.frombuffer(raw, np.uint8)
    return marks


def key_filter(rows: DataFrame, key: str) -> Marks:
    """A filter of the keys (long) in ``rows``."""
    keys = rows.select(key)
    return sketch(keys, lambda batch: batch.column(0).to_numpy().view(np.uint64), keys.count(), 1)


def keeping(batches, key: str, marks: Marks, want: bool):
    """The rows of Arrow batches whose key may be in the filter, or with ``want`` false those whose key is not."""
    for batch in batches:
        k = batch.schema.get_field_index(key)
        yes = marks.may_hold(batch.column(k).to_numpy().view(np.uint64))
        yield batch.filter(pa.array(yes == want))


def rows_in(rows: DataFrame, key: str, marks: Broadcast) -> DataFrame:
    """Rows whose key may be in the filter."""
    return rows.mapInArrow(lambda batches: keeping(batches, key, marks.value, True), rows.schema)


def octets(rows: DataFrame, column: str = "text") -> int:
    return rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
