"""Array-of-double vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelsieve.functions.control import bind


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda total, v: total + v * v))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; an all-zero vector stays zero. The norm is computed once for the vector."""
    def scale(norm: Column) -> Column:
        return F.when(norm > 0, F.transform(as_doubles(vector), lambda v: v / norm)).otherwise(as_doubles(vector))

    return bind(l2_norm(vector), scale)


def is_finite_number(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def has_non_finite(vector: Column) -> Column:
    return F.exists(as_doubles(vector), lambda v: ~is_finite_number(v))
