"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def settled(x: Column, places: int = 6) -> Column:
    """Rounded after a nudge, so that sums in another order give the same digits."""
    return F.round(x + 1e-9, places)


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of an array<double> column as a matrix; they must be of one length, see of_one_length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.unique(pc.fill_null(pc.list_value_length(column), -1).to_numpy())
    if len(lengths) > 1 or (len(lengths) and lengths[0] < 0):
        raise ValueError(f"vectors of several lengths, or null ones (-1): {lengths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrix_with_gaps(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The rows of a column of vectors as a matrix, null ones as NaN, which no comparison lets through."""
    there = column.is_valid().to_numpy()
    out = np.full((len(column), dims), np.nan)
    if there.any():
        out[there] = matrix_of(column.drop_null())
    return out


def common_length(df: DataFrame, column: str = "vector") -> tuple[int, int]:
    """(dims, rows) of the most frequent length of the vectors, the longer of two as frequent; (0, 0) without any."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    often = sizes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return (often[0]["dims"], often[0]["n"]) if often else (0, 0)


def of_one_length(df: DataFrame, dims: int | None = None, column: str = "vector") -> DataFrame:
    """The rows whose vector is not null, has dims components (by default as most have), and none that is null or not finite."""
    if dims is None:
        dims, _ = common_length(df, column)
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return df.where(F.coalesce((F.size(column) == dims) & finite, F.lit(False)))
