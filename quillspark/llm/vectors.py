"""What both vector operators share: which vectors take part, and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample


def usable(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    inf = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column of one length, as doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def sample(df: DataFrame, total: int, size: int, key: str) -> np.ndarray:
    """At most `size` of `total` unit vectors, those of least hash, on the driver."""
    rows = bounded_sample(df, total, size, key).select("embedding").collect()
    return unit(np.array([r[0] for r in rows], np.float64)) if rows else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x
