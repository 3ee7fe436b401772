"""Vector columns: which rows take part, and their values as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widths(df: DataFrame, col: str = "embedding") -> list[int]:
    """The numbers of components that stand in the table, empty vectors left out; vectors of one width form a space of their own."""
    return sorted(r["d"] for r in df.where(F.size(col) > 0).select(F.size(col).alias("d")).distinct().collect())


def usable(dim: int, col: str = "embedding") -> Column:
    """True for vectors of ``dim`` finite components that aren't all zero."""
    return F.coalesce((F.size(col) == dim) & usable_at_all(col), F.lit(False))


def usable_at_all(col: str = "embedding") -> Column:
    """True for vectors of any width with finite components that aren't all zero."""
    finite = F.forall(F.col(col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(F.col(col), lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal width as a matrix of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float32()))
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, dim)


def sample(df: DataFrame, key: str, dim: int, n: int, col: str = "embedding") -> np.ndarray:
    """``n`` rows at most, the first by a hash of ``key``: the same ones in every run."""
    rows = df.orderBy(F.xxhash64(F.lit(17), F.col(key)), key).limit(n).select(col).toArrow()
    return matrix(rows[col], dim) if rows.num_rows else np.zeros((0, dim))
