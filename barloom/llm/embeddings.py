"""What the embedding operators share: valid vectors and cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def is_valid(vector: str = "embedding") -> Column:
    """Not null, not empty, without null or non-finite components, and not all zero."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_type(df: DataFrame, vector: str = "embedding") -> str:
    """Floats stay floats, which is half the bytes to shuffle; any other number becomes a double."""
    return "array<float>" if df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) else "array<double>"


def valid_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(vector_type(df, vector)).alias("embedding")).where(is_valid())


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows are equally long, as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row; the same pair always gives the same double, wherever it stands."""
    q, v = q / np.abs(q).max(1, keepdims=True), v / np.abs(v).max(1, keepdims=True)
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))
