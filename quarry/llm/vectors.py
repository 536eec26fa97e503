"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import return_memory


def is_usable(vector: str = "embedding", key: str = "vec_id") -> Column:
    """Whether the key is set and the vector is set, finite in every component and not zero."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as float64."""
    return_memory()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in an order that depends on nothing else."""
    return (a * b).sum(axis=1)
