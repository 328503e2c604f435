"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    """Round half up by the same floating-point steps on every engine."""
    scale = F.lit(float(10**places))
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / scale


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """``part / whole`` rounded; 0 where there is nothing to divide by."""
    return F.when(whole > 0, half_up(part / whole, places)).otherwise(F.lit(0.0))


def at_least(value: Column, cuts: list[tuple[float, int]], default: int) -> Column:
    """Score of the first cut that the value reaches; cuts run from high to low."""
    chain = F.when(value >= F.lit(cuts[0][0]), F.lit(cuts[0][1]))
    for cut, score in cuts[1:]:
        chain = chain.when(value >= F.lit(cut), F.lit(score))
    return chain.otherwise(F.lit(default))
