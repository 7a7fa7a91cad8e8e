"""Tables an analyst console reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions import far_place, iso_utc
from watchframe.schema import LABELS, mitre_of, severity


def with_severity(alerts: DataFrame, risk: str = "risk") -> DataFrame:
    return alerts.withColumn("severity", severity(F.col(risk)))


def is_alarm(risk: Column, above: float = 80.0) -> Column:
    """Whether a risk is shown as an alarm."""
    return risk > above


def triage_queue(scored: DataFrame, limit: int = 100, only: str | None = None, risk: str = "risk") -> DataFrame:
    """The riskiest events, optionally of one severity: a top-k report, kept to k rows per task."""
    rows = with_severity(scored, risk)
    if only:
        rows = rows.where(F.col("severity") == only.upper())
    top = rows.orderBy(F.desc(risk), F.asc("event_id")).limit(limit)
    return top.select(
        "event_id",
        iso_utc(F.col("timestamp")).alias("timestamp"),
        "entity_id",
        F.col("source_ip").alias("origin_ip"),
        F.initcap(F.replace("predicted", F.lit("_"), F.lit(" "))).alias("attack_vector"),
        F.regexp_extract(mitre_of(F.col("predicted")), r"^(T[0-9.]+)", 1).alias("mitre_tag"),
        F.col(risk).alias("risk_score"),
        "severity",
        is_alarm(F.col(risk)).alias("alarm"),
    )


def around_entity(log: DataFrame, entity_id: str, span_us: int) -> DataFrame:
    """The rows of a prepared log that the rules of one entity's events can read: its own, and those on its addresses
    from `span_us` before its first event there to its last one. The filters reach the scan; the addresses are few."""
    own = log.where(F.col("entity_id") == entity_id)
    seen = own.groupBy(F.col("source_ip").alias("_ip")).agg(F.min("ts_us").alias("_from"), F.max("ts_us").alias("_to"))
    near = F.col("ts_us").between(F.col("_from") - span_us, F.col("_to"))
    return log.join(seen, (F.col("source_ip") == F.col("_ip")) & near, "left_semi")


def entity_timeline(ruled: DataFrame, entity_id: str) -> DataFrame:
    """One entity's events in time order with the rules they tripped."""
    return (
        ruled.where(F.col("entity_id") == entity_id)
        .select(
            "event_id",
            iso_utc(F.col("timestamp")).alias("timestamp"),
            "resource_accessed",
            (F.size("rule_hits") > 0).alias("anomalous"),
            F.array_join(F.transform("rule_hits", lambda h: h["rule"]), ",").alias("rules"),
            F.array_join(F.transform("rule_hits", lambda h: F.format_string("[%s] %s", h["mitre"], h["detail"])), "; ").alias("trace"),
        )
        .orderBy("timestamp", "event_id")
    )


def kpi_tiles(log: DataFrame, report: DataFrame | None = None, hours: int | None = None) -> DataFrame:
    """One row: events, active alerts, drift index.

    All events count, or with `hours` those within that time of the last event. Without a report
    (metric, class, value) the alerts are a fixed share of the events and the index is 0.04.
    """
    if hours is not None:
        last = log.agg(F.max("timestamp")).scalar()
        log = log.where(F.col("timestamp") > last - F.make_dt_interval(hours=F.lit(hours)))
    tiles = log.agg(F.count("*").alias("events_analyzed"))
    if report is None:
        alerts = F.when(F.col("events_analyzed") > 0, F.floor(F.col("events_analyzed") * 0.0001)).otherwise(14)
        return tiles.withColumns({"active_alerts": alerts.cast("long"), "drift_index": F.lit(0.04)})
    support = (F.col("metric") == "support") & F.col("class").isin(LABELS[1:])
    f1 = (F.col("metric") == "f1") & (F.col("class") == "insider_drift")
    found = report.agg(
        F.coalesce(F.sum(F.when(support, F.col("value"))), F.lit(0.0)).alias("attacks"),
        F.coalesce(F.max(F.when(f1, F.col("value"))), F.lit(0.41)).alias("f1"),
    ).select(
        F.when(F.col("attacks") > 0, F.floor(F.col("attacks") * 0.10)).otherwise(14).cast("long").alias("active_alerts"),
        F.bround(1.0 - F.col("f1"), 2).alias("drift_index"),
    )
    return tiles.withColumns({c: found.select(c).scalar() for c in found.columns})


def event_rate(log: DataFrame, width: str = "1 second") -> DataFrame:
    """Events and failures per tumbling window and cohort."""
    failed = (~F.coalesce("auth_success", F.lit(True))).cast("long")
    grouped = log.groupBy(F.window("timestamp", width), "entity_type").agg(
        F.count("*").alias("events"), F.sum(failed).alias("failures")
    )
    return grouped.select(
        F.unix_seconds("window.start").alias("window_start"), "entity_type", "events", "failures"
    )


def recent_events(log: DataFrame, limit: int = 6) -> DataFrame:
    """The latest events."""
    return log.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


def far_places(homes: DataFrame, min_km: float = 2000.0) -> DataFrame:
    """For each row with `lat` and `lon` the first reference place far enough away."""
    place = far_place(F.col("lat"), F.col("lon"), min_km)
    return homes.withColumn("_p", place).select(*homes.columns, F.col("_p.city").alias("far_city"), F.col("_p.km").alias("far_km"))


def entity_homes(log: DataFrame) -> DataFrame:
    """Place of each entity's first event."""
    fix = F.min_by(F.struct(F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon")), F.struct("timestamp", "event_id"))
    return log.groupBy("entity_id").agg(fix.alias("_h")).select("entity_id", "_h.lat", "_h.lon")
