"""The prepared log: the columns every ordered operator relies on, with missing values settled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.functions import device_key, epoch_us


def prepared(log: DataFrame) -> DataFrame:
    """Add `ts_us`, `failed` and `device`; give optional columns their defaults.

    A missing outcome counts as a success. Missing text is "", missing numbers are 0. The order of the
    log is (ts_us, event_id).
    """
    return log.withColumns(
        {
            "ts_us": epoch_us(F.col("timestamp")),
            "failed": (~F.coalesce("auth_success", F.lit(True))).cast("int"),
            "device": device_key(F.col("device_os"), F.col("device_mac")),
            "device_mac": F.coalesce("device_mac", F.lit("")),
            "resource_accessed": F.coalesce("resource_accessed", F.lit("")),
            "source_ip": F.coalesce("source_ip", F.lit("")),
            "geo_lat": F.coalesce("geo_lat", F.lit(0.0)),
            "geo_lon": F.coalesce("geo_lon", F.lit(0.0)),
            "session_duration": F.coalesce("session_duration", F.lit(0.0)),
            "bytes_transferred": F.coalesce("bytes_transferred", F.lit(0)),
        }
    )
