"""Distances on the globe as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchframe.schema import PLACES

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres; null when a coordinate is."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    a = F.when(a > 1, 1.0).otherwise(a)  # antipodes may exceed 1 by an ulp; `least` would hide a null
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def speed_kmh(
    lat1: Column, lon1: Column, seconds1: Column, lat2: Column, lon2: Column, seconds2: Column
) -> Column:
    """Speed between two fixes; infinite when the place changed in no time."""
    km = haversine_km(lat1, lon1, lat2, lon2)
    hours = F.abs(seconds2 - seconds1) / 3600.0
    still = F.when(km > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(hours > 0, km / F.nullif(hours, F.lit(0.0))).otherwise(still)


def far_place(lat: Column, lon: Column, min_km: float = 2000.0) -> Column:
    """First reference place at least `min_km` away, else the farthest one.

    The places are a fixed list of 50, so this is an array expression on each row and not a join.
    """
    places = F.array(
        *[
            F.struct(
                F.lit(city).alias("city"),
                F.lit(country).alias("country"),
                haversine_km(lat, lon, F.lit(plat), F.lit(plon)).alias("km"),
            )
            for city, country, plat, plon in PLACES
        ]
    )
    far = F.filter(places, lambda p: p["km"] >= min_km)
    # aggregate keeps the earlier place on equal distances
    farthest = F.aggregate(places, F.get(places, F.lit(0)), lambda best, p: F.when(p["km"] > best["km"], p).otherwise(best))
    return F.coalesce(F.get(far, F.lit(0)), farthest)
