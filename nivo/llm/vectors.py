"""Vectors of a table as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components beyond it are cut to it, so that they and small sums of them are longs.
MOST = float(1 << 62)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    return F.coalesce(finite, F.lit(False))


def scaled(vector: Column, factor: float = 1024.0, offset: int = 0) -> Column:
    """``floor(factor * c) + offset`` of each component as double; what is beyond ``MOST`` is cut to it."""
    return F.transform(
        vector,
        lambda c: F.floor(F.greatest(F.least(c.cast("double") * factor, F.lit(MOST)), F.lit(-MOST))) + offset,
    )


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)
