"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The diameter in km and the value of pi the distance is defined with.
EARTH_DIAMETER_KM = 2 * 6378.2
PI = 3.14159265


def great_circle_km(lat1: Column | str, lon1: Column | str,
                    lat2: Column | str, lon2: Column | str) -> Column:
    """Haversine distance in km between two points given in degrees."""
    a_lat, a_lon, b_lat, b_lon = (
        (F.col(c) if isinstance(c, str) else c).cast("double") * (PI / 180)
        for c in (lat1, lon1, lat2, lon2)
    )
    chord = (F.pow(F.sin((b_lat - a_lat) / 2), 2)
             + F.cos(a_lat) * F.cos(b_lat) * F.pow(F.sin((b_lon - a_lon) / 2), 2))
    return F.lit(EARTH_DIAMETER_KM) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))
