"""Aggregates that Spark defines differently from the sample statistics needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(col: Column) -> Column:
    """Bias-corrected skewness; NULL below three values, 0 for a constant."""
    n = F.count(col).cast("double")
    corrected = F.skewness(col) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.stddev_pop(col) == 0, 0.0).otherwise(corrected)


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage that is 0, not NULL, for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def exact_sum(amount: Column, digits: int = 2) -> Column:
    """Sum of rounded amounts in decimal arithmetic: the same in any row order."""
    return F.sum(amount.cast(f"decimal(24,{digits})"))


def exact_mean(amount: Column, digits: int = 2) -> Column:
    return F.try_divide(exact_sum(amount, digits).cast("double"), F.count(amount).cast("double"))


def weighted_sum(amount: Column, weight: Column) -> Column:
    """Sum of an amount in cents that stands for ``weight`` rows."""
    return F.sum(amount.cast("decimal(16,2)") * weight.cast("decimal(14,0)"))
