"""What the operators on vectors share: which rows take part, and their components as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and has components, all of them present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column of ``dim`` doubles each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def common_length(rows: DataFrame, vector: str) -> int:
    """The commonest length of vectors, the greatest of those as common; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0
