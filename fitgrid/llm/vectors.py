"""Reading embedding columns inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Whether a vector can have a cosine: not null or empty, all components finite, not zero."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & fine & F.exists(x, lambda v: v != 0)


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(usable(), F.lit(False))).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def cosine_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of matching rows in double precision; equal pairs of rows give equal values wherever they stand."""
    def dot(x, y):
        return np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
