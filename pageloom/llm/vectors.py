"""Tables of vectors: which rows take part, and lists of numbers as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import stored

#: Numbers in one side of a tile: what a task holds of a table at once.
TILE_CELLS = 1 << 18


def finite(vector: Column) -> Column:
    """True where the vector is there and every component is a finite number."""

    def good(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    return vector.isNotNull() & F.forall(vector, good)


def numbered(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` stored with ``row``, a number that tells equal rows apart and stays."""
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), purpose)


def width(rows: DataFrame, vector: str = "v") -> int:
    """Components of the longest vector; shorter ones are filled up with zeros."""
    return rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def per_tile(dim: int) -> int:
    """Rows of one side of a tile."""
    return max(64, TILE_CELLS // max(dim, 1))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    """A column of lists as rows of ``dim`` numbers, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), kind)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(rows.ravel(), type=kind))


def dealt(rows: DataFrame, into: int | Column, salt: str, name: str) -> DataFrame:
    """``rows`` with ``name``, one of ``into`` parts by the hash of ``row``: parts of
    about equal size whatever the rows hold."""
    parts = F.lit(into) if isinstance(into, int) else into
    return rows.withColumn(name, F.pmod(F.xxhash64("row", F.lit(salt)), parts.cast("bigint")))


def part_of(total: int | Column, size: int) -> Column:
    """How many parts of ``size`` rows a total needs, one at least."""
    total = F.lit(total) if isinstance(total, int) else total
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")
