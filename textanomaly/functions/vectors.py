"""Array arithmetic as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def squared_distance(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)))


def absolute_distance(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: F.abs(a - b)))


def euclidean_distance(left: Column, right: Column) -> Column:
    return F.sqrt(squared_distance(left, right))


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A literal matrix: bounded by the caller's Python list, part of the plan."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])


def times_rows(vector: Column, rows: Column) -> Column:
    """Dot product of ``vector`` with every row of a matrix column."""
    return F.transform(rows, lambda row: dot(vector, row))
