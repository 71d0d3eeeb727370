"""Integer vectors shared by the vector operators: floor(scale * x) of every component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Components from this size on, after scaling, are refused: sums of squares would leave 64 bits.
MOST = 2**27


def whole(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""

    def sound(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.coalesce(vector.isNotNull() & F.forall(vector, sound), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components floor(scale * x), x as double; one of ``MOST`` or more is an error."""

    def floored(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        far = F.abs(x.cast("double") * scale) >= MOST
        return F.when(far, F.raise_error(F.lit(f"a component of {MOST} or more after scaling")).cast("long")).otherwise(y)

    return F.transform(vector, floored)


def kept(rows: DataFrame, id_col: str, vector_col: str, *others: Column, scale: int = SCALE) -> DataFrame:
    """(id, v, others...) of the rows whose vector is whole; ``v`` is an array of integers."""
    own = F.col(vector_col)
    return rows.where(whole(own)).select(F.col(id_col).cast("long").alias("id"), integers(own, scale).alias("v"), *others)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``width`` columns; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)
    out[row, place] = values[ends[0] : ends[-1]]
    return out
