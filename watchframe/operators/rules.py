"""The four deterministic detectors.

Each `with_*` function takes a prepared log (see `log.prepared`) and adds the numbers its rule needs and
its flag; `with_rules` runs all four and assembles the hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions import haversine_km
from watchframe.functions.scalars import MINUTE_US
from watchframe.operators.log import prepared
from watchframe.operators.scans import Spec, Wanted
from watchframe.schema import RULE_FLAGS, RULES

TAGS = {
    "brute_force": "T1110",
    "impossible_travel": "T1078",
    "credential_stuffing": "T1110.004",
    "device_spoofing": "T1036",
}


ENTITY_INPUTS = frozenset({"ts_us", "geo_lat", "geo_lon", "device", "failed"})
ADDRESS_INPUTS = frozenset({"ts_us", "entity_id", "failed"})


@dataclass(frozen=True)
class Thresholds:
    brute_force_minutes: int = 10
    brute_force_failures: int = 8
    max_speed_kmh: float = 900.0
    stuffing_minutes: int = 15
    stuffing_targets: int = 15
    stuffing_fail_rate: float = 0.70


# ---- entity rules: one hash partitioning by entity serves all three ------------------------------


def previous_event() -> Wanted:
    """Time, place and device of the entity's previous event."""
    return Wanted(
        prev={
            "prev_us": F.col("ts_us"),
            "prev_lat": F.col("geo_lat"),
            "prev_lon": F.col("geo_lon"),
            "prev_device": F.col("device"),
        }
    )


def entity_spec(t: Thresholds) -> Spec:
    """What the entity rules look back at: the previous event, and failures of the last minutes."""
    failed = F.col("failed").cast("long")
    return Spec(want=previous_event(), moves={"recent_failures": (t.brute_force_minutes * MINUTE_US, failed, failed)}, inputs=ENTITY_INPUTS)


def brute_force(df: DataFrame, t: Thresholds) -> DataFrame:
    """Too many recent failures. A successful event can carry the hit."""
    return df.withColumn("rule_brute_force", _flag(F.col("recent_failures") >= t.brute_force_failures))


def travel(df: DataFrame, t: Thresholds) -> DataFrame:
    """Speed from the previous event; no speed when no time has passed."""
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("geo_lat"), F.col("geo_lon"))
    gap = F.col("ts_us") - F.col("prev_us")
    df = df.withColumns({"travel_km": km, "travel_hours": F.when(gap > 0, gap / 3.6e9)})
    df = df.withColumn("travel_kmh", F.try_divide("travel_km", "travel_hours"))
    fires = F.coalesce(F.col("travel_kmh") > t.max_speed_kmh, F.lit(False))
    return df.withColumn("rule_impossible_travel", _flag(fires))


def spoofing(df: DataFrame) -> DataFrame:
    """Device differs from the one of the previous event."""
    changed = F.coalesce(F.col("prev_device") != F.col("device"), F.lit(False))
    return df.withColumn("rule_device_spoofing", _flag(changed))


# ---- address rule --------------------------------------------------------------------------------


def address_spec(t: Thresholds) -> Spec:
    """Events, failures and distinct entities on the address in the last minutes.

    Distinct entities come without collecting sets: the visits of one entity to the address fall into
    chains whose gaps are within the span. An entity is in the frame from the first visit of a chain
    until the span after its last, so the count is chains begun minus chains that ran out.
    """
    span = t.stuffing_minutes * MINUTE_US
    at = F.col("ts_us")
    visits = Wanted(prev={"_last_visit": at}, next={"_next_visit": at})
    one, failed = F.lit(1).cast("long"), F.col("failed").cast("long")
    begins = F.coalesce(at - F.col("_last_visit") > span, F.lit(True)).cast("long")
    ends = F.coalesce(F.col("_next_visit") - at > span, F.lit(True)).cast("long")
    moves = {"ip_events": (span, one, one), "ip_failures": (span, failed, failed), "ip_targets": (span, begins, ends)}
    return Spec(pairs={("source_ip", "entity_id"): visits}, moves=moves, inputs=ADDRESS_INPUTS)


def stuffing(df: DataFrame, t: Thresholds) -> DataFrame:
    """Many entities tried from one address, mostly failing."""
    df = df.withColumn("ip_fail_rate", F.col("ip_failures") / F.col("ip_events"))
    enough = (F.col("ip_events") >= t.stuffing_targets) & (F.col("ip_targets") >= t.stuffing_targets)
    fires = enough & (F.col("ip_fail_rate") >= t.stuffing_fail_rate)
    return df.withColumn("rule_credential_stuffing", _flag(fires)).drop("_last_visit", "_next_visit")


# ---- assembly ------------------------------------------------------------------------------------


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def confidences(t: Thresholds) -> dict[str, Column]:
    one = F.lit(1.0)
    return {
        "brute_force": F.least(one, F.col("recent_failures") / (t.brute_force_failures * 2)),
        "impossible_travel": F.least(one, F.col("travel_kmh") / (t.max_speed_kmh * 3)),
        "credential_stuffing": F.least(one, F.col("ip_targets") / (t.stuffing_targets * 2)),
        "device_spoofing": F.lit(0.8),
    }


def details(t: Thresholds) -> dict[str, Column]:
    """Hit texts. `bround` makes halves round to even."""
    return {
        "brute_force": F.format_string(f"%d failed auths in {t.brute_force_minutes} min", "recent_failures"),
        "impossible_travel": F.format_string(
            "%.0f km in %.2fh (%.0f km/h)",
            F.bround("travel_km", 0),
            F.bround("travel_hours", 2),
            F.bround("travel_kmh", 0),
        ),
        "credential_stuffing": F.format_string(
            "%d accounts, %.0f%% failure from IP %s",
            "ip_targets",
            F.bround(F.col("ip_fail_rate") * 100, 0),
            "source_ip",
        ),
        "device_spoofing": F.format_string("Fingerprint mismatch: expected %s, got %s", "prev_device", "device"),
    }


def hits(t: Thresholds) -> Column:
    """Array of the rules that fired, in rule order."""
    confidence, detail = confidences(t), details(t)
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"rule_{rule}") == 1.0,
                    F.struct(
                        F.lit(rule).alias("rule"),
                        detail[rule].alias("detail"),
                        F.lit(TAGS[rule]).alias("mitre"),
                        confidence[rule].alias("confidence"),
                    ),
                )
                for rule in RULES
            ]
        )
    )


def flags_of(hit_list: Column) -> dict[str, Column]:
    """One-hot rule flags from a hit array."""

    def fired(rule: str) -> Column:
        return F.exists(hit_list, lambda h: h["rule"] == rule)

    return {f"rule_{rule}": _flag(fired(rule)) for rule in RULES}


def entity_rules(df: DataFrame, t: Thresholds) -> DataFrame:
    return spoofing(travel(brute_force(df, t), t))


def with_entity_rules(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Brute force, impossible travel and device spoofing. What a query does not select is pruned away."""
    return entity_rules(entity_spec(t).over(df, "entity_id"), t)


def with_address_rules(df: DataFrame, t: Thresholds = Thresholds(), source: DataFrame | None = None) -> DataFrame:
    """Credential stuffing."""
    return stuffing(address_spec(t).over(df, "source_ip", source), t)


def with_rules(log: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """All rule numbers, flags and the `rule_hits` array for every event of a log."""
    df = prepared(log)
    return with_address_rules(with_entity_rules(df, t), t, df).withColumn("rule_hits", hits(t))


__all__ = ["RULE_FLAGS", "Thresholds", "flags_of", "hits", "with_address_rules", "with_entity_rules", "with_rules"]
