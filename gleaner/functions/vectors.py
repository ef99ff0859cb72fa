"""Array arithmetic that stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features up to which expressions over array elements are unrolled; beyond, Arrow batches are faster.
UNROLL = 32


def constant(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(features: str, weights: Sequence[float]) -> Column:
    """features . weights, as a sum of products: part of whole-stage code."""
    if len(weights) > UNROLL:
        return F.aggregate(F.zip_with(features, constant(weights), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    total: Column = F.lit(0.0)
    for i, v in enumerate(weights):
        total = total + F.get(F.col(features), F.lit(i)) * F.lit(float(v))
    return total


def quadratic(features: str, matrix: np.ndarray) -> Column:
    """|matrix . features|^2 for a small matrix: a row's leverage if the matrix is the transposed inverse of R."""
    total: Column = F.lit(0.0)
    for row in matrix:
        part = dot(features, row)
        total = total + part * part
    return total
