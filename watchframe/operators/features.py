"""The behavioural features of each event, from the event and the earlier rows of its keys.

Features are grouped by the key they are partitioned by, so the full set needs one shuffle each for
entity, address and resource. The six z-scores and the maturity columns come from `baseline`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions import haversine_km, hour_of_day, shannon_bits
from watchframe.functions import weekday as weekday_of
from watchframe.functions.scalars import DAY_US, hour_angle
from watchframe.operators.carried import resumed
from watchframe.operators.log import prepared
from watchframe.operators.rules import ADDRESS_INPUTS, ENTITY_INPUTS, previous_event
from watchframe.operators.scans import Spec, Wanted, running_index
from watchframe.schema import FEATURES

SECOND = 1_000_000
FLAG_KMH = 900.0
HOUR_SPAN = 3600 * SECOND
EXPANSION_SPAN = 7 * DAY_US
AUTH_EVENTS = 50


def _flag(condition: Column) -> Column:
    return condition.cast("double")


# ---- row-local -----------------------------------------------------------------------------------


def temporal() -> dict[str, Column]:
    hour, dow = hour_of_day(F.col("ts_us")), weekday_of(F.col("ts_us"))
    return {
        "hour_sin": F.sin(hour_angle(F.col("ts_us"))),
        "hour_cos": F.cos(hour_angle(F.col("ts_us"))),
        "day_of_week": dow.cast("double"),
        "is_weekend": _flag(dow >= 5),
        "is_work_hours": _flag(hour.between(8, 18)),
        "is_off_hours": _flag((hour < 6) | (hour > 22)),
    }


def constants() -> dict[str, Column]:
    """Columns that carry no signal yet but belong to the layout."""
    return {c: F.lit(0.0) for c in ("auth_method_mismatch", "is_new_geo", "protocol_mismatch")}


def raw_values(parse_commands: bool) -> dict[str, Column]:
    """Values as they are. Command entropy is 0 unless commands are asked for, as with logs read from CSV."""
    entropy = shannon_bits(F.col("command_sequence")) if parse_commands else F.lit(0.0)
    return {
        "session_duration_raw": F.col("session_duration").cast("double"),
        "bytes_transferred_raw": F.col("bytes_transferred").cast("double"),
        "command_entropy": entropy,
    }


# ---- keyed by entity -----------------------------------------------------------------------------


def entity_spec(windowed_frequency: bool = False) -> Spec:
    """All look-backs of the entity features, on one partitioning."""
    first = {c: (F.col(f"_uses_{c}") == 1).cast("long") for c in ("resource_accessed", "device_mac")}
    seven_days = first["resource_accessed"]
    moves = {"_novel_7d": (EXPANSION_SPAN, seven_days, seven_days)}
    if windowed_frequency:
        one = F.lit(1).cast("long")
        moves["_in_hour"] = (HOUR_SPAN, one, one)
    return Spec(
        pairs={
            ("entity_id", c): Wanted(sums={f"_uses_{c}": F.lit(1)}) for c in ("resource_accessed", "device_mac", "device")
        },
        want=previous_event()
        | Wanted(
            first={"_lat0": F.col("geo_lat"), "_lon0": F.col("geo_lon")},
            sums={"_rank": F.lit(1), "_used": first["resource_accessed"], "_macs": first["device_mac"]},
            tails={"_recent_fails": (F.col("failed").cast("long"), AUTH_EVENTS)},
        ),
        moves=moves,
        inputs=ENTITY_INPUTS | {"resource_accessed", "device_mac"},
    )


def activity(windowed_frequency: bool = False) -> dict[str, Column]:
    """Gap, frequency and failure rate.

    `session_frequency_1h` counts all earlier events of the entity; with `windowed_frequency` it counts
    those of the last hour.
    """
    frequency = F.col("_in_hour") - 1 if windowed_frequency else F.col("_rank") - 1
    return {
        "time_since_last": F.coalesce((F.col("ts_us") - F.col("prev_us")) / SECOND, F.lit(0.0)),
        "session_frequency_1h": frequency.cast("double"),
        "auth_failure_rate": F.col("_recent_fails") / F.least(F.col("_rank"), F.lit(AUTH_EVENTS)),
    }


def expansion() -> dict[str, Column]:
    """First use of a resource by the entity, how many it has used, and how many are new in seven days."""
    used = F.col("_used")
    return {
        "resource_novelty": _flag(F.col("_uses_resource_accessed") == 1),
        "resource_diversity": used.cast("double"),
        "privilege_expansion_rate": F.when(used > 1, 1.0 / used).otherwise(0.0),
        "privilege_expansion_velocity": F.col("_novel_7d").cast("double"),
    }


def place(df: DataFrame) -> DataFrame:
    """Speed since the previous event and distance from the first one."""
    lat, lon = F.col("geo_lat"), F.col("geo_lon")
    hours = F.greatest((F.col("ts_us") - F.col("prev_us")) / (HOUR_SPAN * 1.0), F.lit(0.001))
    moved = haversine_km(F.col("prev_lat"), F.col("prev_lon"), lat, lon)
    df = df.withColumns(
        {
            "geo_velocity_kmh": F.coalesce(moved / hours, F.lit(0.0)),
            "geo_distance_from_primary": haversine_km(F.col("_lat0"), F.col("_lon0"), lat, lon),
        }
    )
    speed, away = F.col("geo_velocity_kmh"), F.col("geo_distance_from_primary")
    df = df.withColumn("impossible_travel_flag", _flag(speed > FLAG_KMH))
    score = (
        0.3 * F.least(speed / 1000, F.lit(1.0))
        + 0.3 * F.col("impossible_travel_flag")
        + 0.4 * F.least(away / 10000, F.lit(1.0))
    )
    return df.withColumn("geo_anomaly_score", score)


def device() -> dict[str, Column]:
    """Distinct MACs so far; a device never seen on an entity that has a history."""
    new = _flag((F.col("_uses_device") == 1) & (F.col("_rank") > 1))
    return {"device_stability_index": F.col("_macs").cast("double"), "new_device_flag": new, "fingerprint_mismatch": new}


def entity_features(df: DataFrame, windowed_frequency: bool = False) -> DataFrame:
    """Features from the look-backs of `entity_spec`, which are dropped, but for the previous event."""
    df = place(df.withColumns({**activity(windowed_frequency), **expansion(), **device()}))
    spec = entity_spec(windowed_frequency)
    helpers = [c for want in spec.pairs.values() for c in want.sums]
    return df.drop(*helpers, *spec.want.sums, *spec.want.first, *spec.want.tails, *spec.moves)


def with_entity_features(df: DataFrame, windowed_frequency: bool = False) -> DataFrame:
    """All entity-keyed features. What a query does not select is pruned away, windows included."""
    return entity_features(entity_spec(windowed_frequency).over(df, "entity_id"), windowed_frequency)


# ---- keyed by address and resource ---------------------------------------------------------------


def address_spec() -> Spec:
    """Distinct entities on the address, and its events, so far."""
    first = (F.col("_visits") == 1).cast("long")
    return Spec(
        pairs={("source_ip", "entity_id"): Wanted(sums={"_visits": F.lit(1)})},
        want=Wanted(sums={"_entities": first, "_ip_seen": F.lit(1)}),
        inputs=ADDRESS_INPUTS,
    )


def address_features(df: DataFrame) -> DataFrame:
    """Keeps `_ip_seen` for `with_frequencies`."""
    return df.withColumn("unique_entities_per_ip", F.col("_entities").cast("double")).drop("_visits", "_entities")


def with_address_features(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return address_features(address_spec().over(df, "source_ip", source))


def resource_spec() -> Spec:
    return Spec(want=Wanted(sums={"_resource_seen": F.lit(1)}), inputs=frozenset({"ts_us"}))


def with_frequencies(df: DataFrame, source: DataFrame | None = None, resources: DataFrame | None = None, seen: int = 0) -> DataFrame:
    """Share of the resource and of the address among all events so far; needs `_ip_seen`.

    `resources` and `seen` are what an earlier log left: its compacted rows by resource, and how many events there were.
    """
    df = running_index(resumed(resource_spec(), df, "resource_accessed", resources, source), "_seen", source)
    total = F.col("_seen") + seen
    return df.withColumns(
        {
            "resource_freq_encoding": F.col("_resource_seen") / total,
            "ip_freq_encoding": F.col("_ip_seen") / total,
        }
    ).drop("_resource_seen", "_ip_seen", "_seen")


# ---- everything but the baseline -----------------------------------------------------------------


def row_features(parse_commands: bool = False) -> dict[str, Column]:
    """Features that need no other row."""
    return {**temporal(), **raw_values(parse_commands), **constants()}


def with_behaviour(df: DataFrame, parse_commands: bool = False, windowed_frequency: bool = False) -> DataFrame:
    """Every feature that needs no baseline, on a prepared log.

    Row-local columns come last, so that shuffles and sorts carry as little as possible.
    """
    out = with_address_features(with_entity_features(df, windowed_frequency), df)
    return with_frequencies(out, df).withColumns(row_features(parse_commands))


def compute_features(log: DataFrame, alpha: float = 0.05, min_events: int = 20, **options: bool) -> DataFrame:
    """event_id and the 37 features of every event of a log, in their order."""
    from watchframe.operators.baseline import with_sequential

    df = with_sequential(with_behaviour(prepared(log), **options), alpha=alpha, min_events=min_events)
    return df.select("event_id", *FEATURES)
