"""Scalar column functions."""

from watchframe.functions.geo import far_place, haversine_km, speed_kmh
from watchframe.functions.scalars import (
    device_key,
    epoch_us,
    finite_or_zero,
    hour_of_day,
    iso_utc,
    shannon_bits,
    weekday,
)

__all__ = [
    "device_key",
    "epoch_us",
    "far_place",
    "finite_or_zero",
    "haversine_km",
    "hour_of_day",
    "iso_utc",
    "shannon_bits",
    "speed_kmh",
    "weekday",
]
