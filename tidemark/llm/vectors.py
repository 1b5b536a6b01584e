"""Vectors as Arrow columns: which take part, how they reach numpy, and the one cosine that decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a matrix product of unit vectors may be off, and more.
SLACK = 1e-9


def usable(vec: str) -> Column:
    """True for vectors with a cosine: not null, no null or non-finite component, not all zero (after squaring)."""
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    return F.coalesce(finite & (norm > 0) & (norm < float("inf")), F.lit(False))


def prepared(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """(id, dim, vec, and more) of the usable rows with an id; vectors of 32-bit floats stay so, others become doubles."""
    kind = "float" if df.select(vec_col).dtypes[0][1] == "array<float>" else "double"
    return df.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.size(vec_col).alias("dim"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"), *more)


def vec_type(vectors: DataFrame) -> str:
    return dict(vectors.dtypes)["vec"]


def matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, row by row, summed in the same order whatever the rows: equal pairs have equal cosines."""
    return (x * y).sum(1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have cosine >= threshold; a matrix product decides but for those so near it that its rounding might."""
    dots = x @ y.T
    hit = dots >= threshold
    a, b = np.nonzero(np.abs(dots - threshold) < SLACK)
    hit[a, b] = cosine(x[a], y[b]) >= threshold
    return hit
