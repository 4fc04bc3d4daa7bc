"""Risk bands and premium arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelmark import constants as K
from keelmark.functions.rounding import rounded


def probability_pct(probability: Column) -> Column:
    return rounded(probability * 100, 2)


def risk_band(pct: Column) -> Column:
    """Band of a percentage; NULL and NaN have no band."""
    band = F.when(pct.isNull() | F.isnan(pct), F.lit(None).cast("string"))
    for name, edge in zip(K.RISK_BANDS, K.RISK_BAND_EDGES):
        band = band.when(pct < edge, name)
    return band.otherwise(K.RISK_BANDS[-1])


def clip_pct(pct: Column) -> Column:
    """Percentage limited to 0..100; NaN becomes NULL."""
    return (
        F.when(F.isnan(pct), F.lit(None).cast("double"))
        .when(pct < 0, 0.0)
        .when(pct > 100, 100.0)
        .otherwise(pct)
    )


@dataclass(frozen=True)
class Premium:
    """Unrounded amounts of one voyage."""

    expected_loss: Column
    risk_premium: Column
    base_premium: Column
    total_premium: Column
    rate_pct: Column


def voyage_premium(
    probability: Column, multiplier: Column, insured_value: Column,
    lgd: Column, theta: Column, base_rate: Column,
) -> Premium:
    """Expected loss, loaded for safety, plus the base premium on the hull."""
    loss = probability * insured_value * lgd * multiplier
    loaded = loss * (F.lit(1.0) + theta)
    base = insured_value * base_rate
    total = loaded + base
    return Premium(loss, loaded, base, total, F.try_divide(total, insured_value) * 100)
