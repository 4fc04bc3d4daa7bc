"""Feature math: logarithm, season, great circle, ordinal codes, label."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelmark import constants as K


def season(month: Column) -> tuple[Column, Column]:
    """Sine and cosine of the month on a circle that starts in January."""
    angle = F.pi() * 2 * (month - 1) / 12
    return F.sin(angle), F.cos(angle)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance between two points given in degrees."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = (
        F.pow(F.sin(half_lat), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    )
    # Rounding can push the chord of two opposite points just above 1.
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * 2 * K.EARTH_RADIUS_KM


def hotspot_km(latitude: Column, longitude: Column) -> Column:
    return haversine_km(latitude, longitude, F.lit(K.HOTSPOT_LATITUDE), F.lit(K.HOTSPOT_LONGITUDE))


def lookup(key: Column, table: dict[str, Any], default: Any) -> Column:
    """A small fixed table as a map literal: neither a join nor an exchange."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def attack_severity(attack_type: Column) -> Column:
    return lookup(attack_type, K.ATTACK_SEVERITY, K.DEFAULT_ORDINAL)


def vessel_vulnerability(vessel_status: Column) -> Column:
    return lookup(vessel_status, K.VESSEL_VULNERABILITY, K.DEFAULT_ORDINAL)


def region_multiplier(region: Column) -> Column:
    return lookup(region, K.REGION_MULTIPLIER, K.DEFAULT_REGION_MULTIPLIER)


def attack_completed(attack_type: Column) -> Column:
    """1 for an attack that was carried through, else 0 (also for NULL)."""
    return F.coalesce(attack_type.isin(*K.COMPLETED_ATTACKS), F.lit(False)).cast("int")
