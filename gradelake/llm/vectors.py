"""Columns of vectors as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components are held to this range, so that squared distances and products of 64 components fit into a long.
HELD = 2**27


def usable(vector: Column) -> Column:
    """True for vectors that are neither null nor hold a null or non-finite component."""
    fine = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, e array<int>) of the usable vectors: each component x as floor(scale * x), x as double."""
    vector = F.col(f"`{vec_col}`")
    whole = lambda x: F.greatest(F.lit(-HELD), F.least(F.lit(HELD), F.floor(F.lit(float(scale)) * x.cast("double")))).cast("int")
    return df.where(usable(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(vector, whole).alias("e"))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """The lists as rows of a matrix of longs, shorter ones filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width or 0, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
