"""Vector algebra over array<double> columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body(*values)`` with each value computed once a row; keeps nested formulas small."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(bound), lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), 1)


def vec(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Vector, b: Vector) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm_sq(a: Vector) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Vector) -> Column:
    return F.sqrt(norm_sq(a))


def scale(a: Vector, by: Column | float) -> Vector:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(a, lambda x: x * by)


def combine(a: Vector, by_a: Column, b: Vector, by_b: Column) -> Vector:
    return F.zip_with(a, b, lambda x, y: x * by_a + y * by_b)


def add(a: Vector, b: Vector) -> Vector:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Vector, b: Vector) -> Vector:
    return F.zip_with(a, b, lambda x, y: x - y)


def normalize(a: Vector) -> Vector:
    """Unit length, unless the vector is unit already within 1e-9 or all but zero."""
    n2 = norm_sq(a)
    return let(lambda v, s: F.when((F.abs(s - 1) <= 1e-9) | (s <= 1e-18), v).otherwise(scale(v, 1 / F.sqrt(s))), a, n2)


def mean_vector(vector: Column, dim: int) -> Column:
    """Aggregate: element-wise mean over a group, for vectors of known length."""
    return F.array(*[F.avg(F.element_at(vector, i + 1)) for i in range(dim)])
