"""Vector arithmetic on ARRAY<DOUBLE> columns, natively."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value, use) -> Column:
    """use(value), with value computed once: inside a lambda, an expression would be computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def cosine(a, b, a_norm=None, b_norm=None) -> Column:
    """0 where either vector is (nearly) zero; norms can be given as columns, so that they are computed once a row."""
    norms = F.struct((norm(a) if a_norm is None else F.col(a_norm)).alias("a"), (norm(b) if b_norm is None else F.col(b_norm)).alias("b"))
    of = lambda n: F.when((n["a"] < TINY) | (n["b"] < TINY), F.lit(0.0)).otherwise(dot(a, b) / (n["a"] * n["b"]))
    if a_norm is not None and b_norm is not None:
        return of({"a": F.col(a_norm), "b": F.col(b_norm)})
    return let(norms, of)


def scale(a, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def normalized(a) -> Column:
    """Unit vector; the vector itself where it is (nearly) zero."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > TINY, F.transform(v, lambda x: x / n)).otherwise(v)))


def blend(a, b, wa, wb) -> Column:
    """wa * a + wb * b."""
    return F.zip_with(a, b, lambda x, y: wa * x + wb * y)


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sum_vectors(vector: str, weight: Column, dim: int) -> Column:
    """Aggregate: weighted sum of vectors, one sum for each component, so it combines before the shuffle."""
    return F.array(*[F.sum(weight * F.col(vector)[i]) for i in range(dim)])


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)
