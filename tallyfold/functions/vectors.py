"""Vector expressions over array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.lit(1.0) - F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def distance_to(vector: Column, query: list[float]) -> Column:
    """Cosine distance of every vector to one query; 1 for a zero vector, null for a vector of another length.

    A whole Arrow batch is one matrix product, several times faster than element-wise array expressions."""
    wanted = np.asarray(query, dtype="float64")
    size = float(np.sqrt(wanted @ wanted))

    @F.arrow_udf(T.DoubleType())
    def distance(batch: pa.Array) -> pa.Array:
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(batch), len(wanted)), False))
        out = np.full(len(batch), np.nan)
        if fits.any():
            matrix = batch.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
            matrix = matrix.astype("float64").reshape(-1, len(wanted))
            scale = np.sqrt((matrix * matrix).sum(axis=1)) * size
            similar = np.divide(matrix @ wanted, scale, out=np.zeros(len(matrix)), where=scale > 0)
            out[fits] = 1.0 - similar
        return pa.array(out, mask=~fits)

    return distance(vector)
