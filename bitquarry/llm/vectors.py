"""Vectors as rows of a matrix, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows ``(id, v array<double>)`` whose id and vector, with every component, are there and finite."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def padded(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of ``width``, zeros after their ends, and their lengths."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int32)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width), lengths
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out, lengths


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` from all rows of ``b``."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))
