"""Cosine similarity of array columns with a query vector."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many dimensions the sum is written out, which keeps it in generated code.
WRITTEN_OUT = 128


def dot(vector: Column | str, query: list[float]) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    if len(query) <= WRITTEN_OUT:
        return reduce(lambda a, b: a + b, [F.get(v, F.lit(i)).cast("double") * F.lit(float(q)) for i, q in enumerate(query)])
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(v, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b)


def norm(vector: Column | str, size: int) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    if size <= WRITTEN_OUT:
        return F.sqrt(reduce(lambda a, b: a + b, [F.get(v, F.lit(i)).cast("double") * F.get(v, F.lit(i)).cast("double") for i in range(size)]))
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(vector: Column | str, query: list[float]) -> Column:
    """Cosine similarity; null for a null or zero vector."""
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    return F.try_divide(dot(vector, query), norm(vector, len(query)) * F.lit(length))
