"""Vector expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this dimension a dot product is unrolled, which code generation compiles; beyond, an array aggregate.
UNROLL = 256


def usable(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.exists(vector, lambda x: x != 0)


def dot(vector: Column, query: list[float]) -> Column:
    if len(query) <= UNROLL:
        return reduce(add, [F.get(vector, F.lit(i)).cast("double") * F.lit(float(q)) for i, q in enumerate(query)])
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(q)) for q in query]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)


def cosine(vector: Column, query: list[float]) -> Column:
    """Similarity to a constant vector; null for a zero vector."""
    norm = sum(q * q for q in query) ** 0.5
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.try_divide(dot(vector, query), F.sqrt(square) * F.lit(norm))
