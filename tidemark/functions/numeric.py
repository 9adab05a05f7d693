"""Rounding and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, digits: int = 0) -> Column:
    """Half-even, as pandas rounds: scale, round to an integer, scale back.

    ``F.round`` is half-up, and ``F.bround`` rounds the decimal text of a double, which is a tie
    where the double itself is not.
    """
    return F.rint(x.cast("double") * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)


def default_zero(x: Column, default) -> Column:
    """Null and zero both become ``default``."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, F.lit(default)).otherwise(x)


def nan_to_zero(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """Division with null or zero denominators counted as 1."""
    return F.coalesce(num, F.lit(0)).cast("double") / default_zero(den, 1)
