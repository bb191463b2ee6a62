"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.Array, dtype=np.float32) -> np.ndarray:
    """Rows of equal length as a matrix."""
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), dtype)
