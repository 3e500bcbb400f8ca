"""Vectors of an Arrow column as matrices of numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(df: DataFrame, vector: str) -> Column:
    """The vector column as array<float> or array<double>; floats become doubles without loss in the tasks."""
    kind = df.schema[vector].dataType.simpleString()
    return F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of vectors that have dims entries each, none of them a null list; null entries of floats become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def floors(values: np.ndarray, scale: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose entries are all finite and below `most` in magnitude once scaled, floor(scale * x) of those as int64), x as double."""
    scaled = values.astype(np.float64) * scale
    good = np.flatnonzero((np.abs(scaled) < most).all(axis=1))  # no comparison holds for NaN
    return good, np.floor(scaled[good]).astype(np.int64)
