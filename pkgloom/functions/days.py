"""Days as numbers in years of 365 days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mini_date(day: Column) -> Column:
    """A day's number: 365 a year and the days since its January 1. A leap year's last day and the next day share one."""
    return F.year(day) * 365 + F.dayofyear(day) - 1


def days_later(number: Column, days: Column) -> Column:
    return number + days


def half_way(a: Column, b: Column) -> Column:
    """The number in the middle, rounded towards ``a``."""
    diff = b - a
    return a + F.signum(diff).cast("int") * F.floor(F.abs(diff) / 2).cast("int")


def pseudo_month(day: Column) -> Column:
    """Months of 30 days from 0; the twelfth takes the rest of the year."""
    return F.least(F.floor((F.dayofyear(day) - 1) / 30).cast("int"), F.lit(11))
