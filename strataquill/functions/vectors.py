"""Vectors as arrays; products in double."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


@lru_cache
def _bag(dims: int):
    @F.arrow_udf("array<double>")
    def bag(slots: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(len(sizes)), sizes) * dims + slots.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(cells, minlength=len(sizes) * dims).reshape(-1, dims).astype(float)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(norms == 0, 1.0, norms)
        return pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dims, dtype=np.int32), unit.ravel(), mask=slots.is_null() if slots.null_count else None)

    return bag


def hashed_bag(tokens: Column, dims: int = 64) -> Column:
    """Unit vector of token counts by crc32 modulo dims: a deterministic stand-in for a text encoder. Spark hashes; the
    slots of a batch of rows are counted at once in Arrow."""
    return _bag(dims)(F.transform(tokens, lambda t: (F.crc32(t) % dims).cast("int")))
