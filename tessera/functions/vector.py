"""Column functions over vectors (arrays of numbers), accumulated in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scores(vectors: Column, query: list[float]) -> Column:
    """Dot products of a column of vectors with one query vector: a matrix product for each Arrow batch.

    A null vector, or one of another length, scores null.
    """
    q = np.asarray(query, float)

    @F.arrow_udf(DoubleType())
    def product(column: pa.Array) -> pa.Array:
        sizes = np.diff(column.offsets.to_numpy())
        good = column.is_valid().to_numpy(zero_copy_only=False) & (sizes == len(q))
        out = np.zeros(len(column))
        if good.any():
            flat = column.filter(pa.array(good)).flatten()
            out[good] = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q)) @ q
        return pa.array(out, mask=~good)

    return product(vectors)
