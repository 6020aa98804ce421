"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088  # fixed value: mean Earth radius


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres between two points given in degrees.

    The argument of the arcsine is kept within [0, 1], so that rounding can never leave its domain.
    Null coordinates give a null distance.
    """
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = (F.sin(half_lat) * F.sin(half_lat)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon))
    inside = F.when(chord.isNotNull(), F.greatest(F.least(chord, F.lit(1.0)), F.lit(0.0)))
    return F.asin(F.sqrt(inside)) * (2 * EARTH_RADIUS_KM)
