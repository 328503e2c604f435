"""Expressions over array columns that hold vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A column used inside a lambda is otherwise worked out again for every array element.
    """
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divide by the length; a zero vector stays zero."""
    divisor = F.when(norm(v) == 0, F.lit(TINY)).otherwise(norm(v))
    return let(divisor, lambda d: F.transform(v, lambda x: x.cast("double") / d))


def softmax(scores: Column, temperature: float = 5.0) -> Column:
    """Soft arg-max of an array of scores, sharpened by the factor ``temperature``."""
    powers = let(
        F.array_max(scores),
        lambda top: F.transform(scores, lambda s: F.exp((s - top) * F.lit(float(temperature)))),
    )
    return let(powers, lambda ps: let(total(ps), lambda t: F.transform(ps, lambda p: p / t)))
