"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_count(c: Column) -> Column:
    """Whole number, junk and null as 0."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0))


def log1p_safe(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def poisson_cost(count: Column, rate: Column) -> Column:
    """Negative log likelihood without the factorial term, which two rates share."""
    return F.when(rate > 0, rate - count * F.log(rate)).when(count == 0, 0.0).otherwise(float("inf"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
