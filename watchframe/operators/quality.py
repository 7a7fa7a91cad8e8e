"""Contract checks: one pass that splits rows into valid ones and rejects with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from watchframe.schema import AUTH_METHODS, ENTITY_TYPES, LABELS


def is_ipv4(ip: Column) -> Column:
    """Four dot-separated runs of digits, each 0..255; leading zeros are fine."""
    octets = F.split(ip, r"\.")
    in_range = F.forall(octets, lambda o: F.regexp_replace(o, "^0+(?=.)", "").try_cast("int").between(0, 255))
    return F.coalesce(ip.rlike(r"^[0-9]+(\.[0-9]+){3}$") & F.coalesce(in_range, F.lit(False)), F.lit(False))


def _missing(*names: str) -> dict[str, Column]:
    return {f"missing {n}": F.col(n).isNull() for n in names}


def event_checks() -> dict[str, Column]:
    """reason -> condition under which a flat event is rejected. Nulls only fail the `missing` checks."""
    required = (
        "event_id", "entity_id", "entity_type", "timestamp", "source_ip", "geo_lat", "geo_lon",
        "resource_accessed", "auth_method", "auth_success", "session_duration",
        "device_os", "device_firmware", "device_mac", "device_protocol",
    )
    return {
        **_missing(*required),
        "entity_type": ~F.col("entity_type").isin(ENTITY_TYPES),
        "auth_method": ~F.col("auth_method").isin(AUTH_METHODS),
        "source_ip": F.col("source_ip").isNotNull() & ~is_ipv4(F.col("source_ip")),
        "geo_lat": ~F.col("geo_lat").between(-90, 90),
        "geo_lon": ~F.col("geo_lon").between(-180, 180),
        "session_duration": ~(F.col("session_duration") >= 0),
        "bytes_transferred": ~(F.col("bytes_transferred") >= 0),
    }


def label_checks() -> dict[str, Column]:
    return {**_missing("event_id", "label"), "label": ~F.col("label").isin(LABELS)}


def profile_checks() -> dict[str, Column]:
    required = (
        "entity_id", "entity_type", "home_lat", "home_lon", "typical_hour_mean", "typical_hour_std", "resource_set",
        "session_duration_mean_log", "auth_method", "device_os", "device_firmware", "device_mac", "device_protocol",
    )
    return {
        **_missing(*required),
        "entity_type": ~F.col("entity_type").isin(ENTITY_TYPES),
        "auth_method": ~F.col("auth_method").isin(AUTH_METHODS),
        "home_lat": ~F.col("home_lat").between(-90, 90),
        "home_lon": ~F.col("home_lon").between(-180, 180),
        "typical_hour_mean": ~F.col("typical_hour_mean").between(0, 24),
        "typical_hour_std": ~((F.col("typical_hour_std") > 0) & (F.col("typical_hour_std") <= 6)),
        "resource_set": ~F.size("resource_set").between(3, 20),
        "session_duration_std_log": ~(F.col("session_duration_std_log") > 0),
        "avg_daily_events": ~(F.col("avg_daily_events") > 0),
        "bytes_mean": ~(F.col("bytes_mean") >= 0),
        "bytes_std": ~(F.col("bytes_std") >= 0),
    }


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add `reasons`, the failed checks in check order (empty when the row is valid)."""
    failed = [F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for reason, bad in checks.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*failed)))


def validate(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with `reasons`)."""
    checked = with_reasons(df, checks)
    ok = F.size("reasons") == 0
    return checked.where(ok).drop("reasons"), checked.where(~ok)


def validate_events(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check flat events; absent commands and volume get their defaults in the valid part."""
    valid, rejects = validate(log, event_checks())
    kind = log.schema["command_sequence"].dataType
    commands = F.lit("[]") if isinstance(kind, StringType) else F.array().cast(kind)
    filled = {
        "command_sequence": F.coalesce("command_sequence", commands),
        "bytes_transferred": F.coalesce("bytes_transferred", F.lit(0)),
    }
    return valid.withColumns(filled), rejects


def validate_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(labels, label_checks())


def validate_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(profiles, profile_checks())
