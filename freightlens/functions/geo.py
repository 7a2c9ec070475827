"""Distances and directions between points in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freightlens.functions.scalars import _col

EARTH_RADIUS_KM = 6371.0  # fixed value


def haversine_km(lat_a, lng_a, lat_b, lng_b) -> Column:
    """Great-circle distance. The half-chord is held at or below 1, which
    rounding can exceed for opposite points."""
    phi_a, phi_b = F.radians(_col(lat_a)), F.radians(_col(lat_b))
    half_lat = F.sin((phi_b - phi_a) / 2)
    half_lng = F.sin((F.radians(_col(lng_b)) - F.radians(_col(lng_a))) / 2)
    chord = half_lat * half_lat + F.cos(phi_a) * F.cos(phi_b) * half_lng * half_lng
    rest = 1 - chord
    rest = F.when(rest < 0, F.lit(0.0)).otherwise(rest)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(rest))


def direction_code(lat_from, lng_from, lat_to, lng_to) -> Column:
    """Compass code -3..3: twice the sign of the latitude step plus the sign of
    the longitude step."""
    north = F.signum(_col(lat_to) - _col(lat_from))
    east = F.signum(_col(lng_to) - _col(lng_from))
    return north * 2 + east
