"""Vector arithmetic on array<double> columns: built-in higher-order functions, summed from the first element to the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-20


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """result(value), with value worked out once: what stands in a lambda function is else worked out for every element."""
    return F.element_at(F.transform(F.array(value), result), 1)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def shift(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x + by)


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def divide(v: Column, by: Column) -> Column:
    return let(by, lambda n: F.transform(v, lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(v: Column) -> Column:
    """Epsilon is added to every element first, so a zero vector becomes a uniform one."""
    return let(shift(v, EPSILON), lambda lifted: divide(lifted, norm(lifted)))


def damped_unit(v: Column) -> Column:
    """Divided by length plus epsilon: a zero vector stays zero."""
    return let(v, lambda x: divide(x, norm(x) + EPSILON))


def argmax(v: Column) -> Column:
    """Place of the largest element from 0; the first of equal ones."""
    return F.array_position(v, F.array_max(v)) - 1
