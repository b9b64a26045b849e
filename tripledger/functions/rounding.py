"""Rounding and means that give the same bits in any order and on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column | str, places: int) -> Column:
    """Half away from zero, decided on value * 10**places as a double."""
    c, scale = F.col(value) if isinstance(value, str) else value, F.lit(10.0**places)
    return F.when(c < 0, -F.floor(-c * scale + F.lit(0.5))).otherwise(F.floor(c * scale + F.lit(0.5))) / scale


def units(value: Column | str, places: int) -> Column:
    """A value of so many decimal places as a whole number of its smallest units."""
    return F.round((F.col(value) if isinstance(value, str) else value) * F.lit(10.0**places)).cast("long")


def mean_of(value: Column | str, places: int) -> Column:
    """The mean of values of so many decimal places, summed as whole numbers, so that order plays no part."""
    c = F.col(value) if isinstance(value, str) else value
    return F.sum(units(c, places)) / F.count(c) / F.lit(10.0**places)
