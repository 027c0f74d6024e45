"""Scalar rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: Column, digits: int) -> Column:
    """Rounds half away from zero on the scaled double, which decimal rounding doesn't reproduce."""
    p = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, default where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(default))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def bucket(x: Column, width: Column) -> Column:
    """Nearest multiple of width; x itself where width isn't positive."""
    return F.when(width > 0, half_away(x / F.when(width > 0, width), 0) * width).otherwise(x)
