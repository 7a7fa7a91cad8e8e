"""Access-log view of a generic event table (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def access_log(events: DataFrame) -> DataFrame:
    """Map generic events to flat access events.

    `label_int`, `risk_stub` and `pred_stub` ride along so that metrics can be run without a model.
    """
    # `ts` has no zone; its wall clock is read as UTC whatever the session time zone is
    clock = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    base = events.withColumns({"k": k})
    user, k, value = F.col("user_id"), F.col("k"), F.col("value")
    kind = F.col("event_type")
    moved = k >= 95
    ubuntu = k % 20 == 0
    raw_risk = value / 4 + k / F.lit(2.0)
    return base.select(
        "event_id",
        user.cast("string").alias("entity_id"),
        F.when(user % 12 < 8, "user").when(user % 12 < 11, "edge_device").otherwise("service_account").alias("entity_type"),
        clock.alias("timestamp"),
        F.concat(F.lit("10.0.0."), k.cast("string")).alias("source_ip"),
        ((user % 100).cast("double") - 50 + F.when(moved, F.lit(30.0)).otherwise(k / F.lit(1000.0))).alias("geo_lat"),
        ((user % 300).cast("double") - 150).alias("geo_lon"),
        F.concat(F.lit("city"), (user % 7 + F.when(moved, 1).otherwise(0)).cast("string")).alias("geo_city"),
        F.lit("XX").alias("geo_country"),
        F.concat(F.lit("res://"), kind, F.lit("/"), (k % 20).cast("string")).alias("resource_accessed"),
        F.when(k % 4 == 0, "password").when(k % 4 == 1, "token").when(k % 4 == 2, "certificate").otherwise("biometric").alias("auth_method"),
        (kind != "error").alias("auth_success"),
        value.alias("session_duration"),
        F.array(
            F.lit("login"),
            F.concat(F.lit("c"), (k % 7).cast("string")),
            F.concat(F.lit("c"), (k % 3).cast("string")),
            kind,
        ).alias("command_sequence"),
        F.when(ubuntu, "Ubuntu 22.04").otherwise("Windows 11").alias("device_os"),
        F.lit("v1.0.0").alias("device_firmware"),
        F.concat(
            F.lit("00:"), (user % 100).cast("string"), F.lit(":"), F.when(ubuntu, k).otherwise(1).cast("string")
        ).alias("device_mac"),
        F.lit("HTTPS").alias("device_protocol"),
        F.round(value * 100).cast("bigint").alias("bytes_transferred"),
        F.when(value > 150, 1 + k % 7).otherwise(0).alias("label_int"),
        F.least(F.lit(100.0), raw_risk).alias("risk_stub"),
        F.when(raw_risk > 50, 1 + (k + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)) % 7).otherwise(0).alias("pred_stub"),
    )


def read_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log(spark.read.parquet(f"{sf_dir}/events.parquet"))
