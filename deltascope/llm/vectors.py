"""Integer vectors of a table, and their passage between Spark and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components stay under this, so that squared distances of 64 of them fit a long.
LARGEST = 2**27


def all_finite(vector: Column) -> Column:
    """True if the vector and all of its components are neither NULL, NaN nor infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def scaled(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, as ``array<int>``; an error if one is over ``LARGEST``."""
    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x.cast("double")) * scale < LARGEST, y.cast("int")).otherwise(
            F.raise_error(F.lit(f"a vector component times {scale} is not under {LARGEST}")).cast("int"))
    return F.transform(vector, whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without NULLs, all of ``dim`` components."""
    flat = column.flatten() if len(column) else pa.array([], pa.int32())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with the rows of a matrix."""
    n, dim = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(values.ravel(), kind))
