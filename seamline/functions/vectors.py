"""Column functions on embedding arrays. Arithmetic is in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors and contexts no longer than this count as zero.
MIN_NORM = 1e-12


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(doubles(left), doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def scaled(vector: Column, factor: Column) -> Column:
    return F.transform(doubles(vector), lambda x: x * factor)


def problem(vector: Column, dim: int | None = None) -> Column:
    """Why a vector cannot be scored, or null if it can: ``missing``,
    ``dimension``, ``not_finite`` or ``zero``. Built-in functions only."""
    unfit = F.exists(doubles(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    wrong_size = F.size(vector) < 1 if dim is None else F.size(vector) != dim
    length = norm(vector)
    return (
        F.when(vector.isNull(), "missing")
        .when(wrong_size, "dimension")
        .when(unfit | (length == float("inf")), "not_finite")
        .when(length <= MIN_NORM, "zero")
    )


def problem_by_batch(vector: Column, dim: int | None = None) -> Column:
    """The same reasons, found for a whole Arrow batch at a time; several times
    faster on long vectors."""

    @F.arrow_udf("string")
    def check(vectors: pa.Array) -> pa.Array:
        return pa.array(problems(vectors, dim), pa.string())

    return check(vector)


def problems(vectors: pa.Array, dim: int | None) -> np.ndarray:
    """The reasons for the vectors of one Arrow array."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    squares = np.zeros(len(sizes))
    filled = sizes > 0
    if filled.any():
        starts = (np.cumsum(sizes) - sizes)[filled]
        with np.errstate(over="ignore", invalid="ignore"):
            squares[filled] = np.add.reduceat(values * values, starts)
    reasons = np.full(len(sizes), None, dtype=object)
    reasons[np.sqrt(squares) <= MIN_NORM] = "zero"
    reasons[~np.isfinite(squares)] = "not_finite"
    reasons[sizes < 1 if dim is None else sizes != dim] = "dimension"
    reasons[vectors.is_null().to_numpy(zero_copy_only=False)] = "missing"
    return reasons
