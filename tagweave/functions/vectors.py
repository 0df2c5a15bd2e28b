"""Column expressions over ``array<double>`` vectors."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def each(array: Column, value: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(entry, value)`` for each entry, with ``value`` computed once per row.

    An expression used inside a lambda is redone for every entry, also when the
    optimizer moves it there; an argument is not.
    """
    return F.zip_with(array, F.array_repeat(value, F.size(array)), fn)


def l2_normalise(vector: Column) -> Column:
    """Unit vector of ``vector``; the zero vector stays zero."""
    return each(vector, norm(vector) + F.lit(1e-9), lambda x, length: x / length)
