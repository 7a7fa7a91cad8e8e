"""Entity profiles from the log: all entities in one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions import epoch_us
from watchframe.functions.scalars import DAY_US, whole_hour
from watchframe.operators.scans import Spec, Wanted

POINTS = 30
VECTOR = ["working_hours", "data_volume", "places", "resources", "auth_failures", "activity"]


def _capped(value: Column) -> Column:
    """At most 100, fraction cut off."""
    return F.least(F.lit(100.0), value.cast("double")).cast("int")


def profiles(log: DataFrame) -> DataFrame:
    """entity_id, cohort, account_age, maturity_weight, maturity_level, behavioral_vector, drift_data."""
    return _summary(log).join(drift_series(log), "entity_id", "left")


def _summary(log: DataFrame) -> DataFrame:
    us = epoch_us(F.col("timestamp"))
    ok = F.coalesce("auth_success", F.lit(True)).cast("int")
    facts = log.groupBy("entity_id").agg(
        F.count("*").alias("n"),
        F.min(us).alias("lo"),
        F.max(us).alias("hi"),
        F.avg(ok).alias("ok_rate"),
        F.sum(1 - ok).alias("fails"),
        F.avg(whole_hour(us).between(8, 18).cast("int")).alias("day_share"),
        F.avg("bytes_transferred").alias("avg_bytes"),
        F.count_distinct("geo_city").alias("cities"),
        F.count_distinct("resource_accessed").alias("resources"),
    )
    systems = log.where(F.col("device_os").isNotNull()).groupBy("entity_id", "device_os").agg(F.count("*").alias("c"))
    modal = systems.groupBy("entity_id").agg(F.min_by("device_os", F.struct(-F.col("c"), F.col("device_os"))).alias("os"))
    both = facts.join(modal, "entity_id", "left")

    n, rate = F.col("n"), F.col("ok_rate")
    days = F.greatest(F.floor((F.col("hi") - F.col("lo")) / DAY_US), F.lit(1))
    years = F.bround(days / 365.0, 1)
    years = F.when(years == 0.0, F.bround((n % 50) / 10.0 + 0.1, 1)).otherwise(years)
    vector = [
        _capped(F.col("day_share") * 100),
        _capped(F.coalesce(F.col("avg_bytes"), F.lit(0.0)) / 50000.0 * 100),
        _capped(F.col("cities") * 20),
        _capped(F.col("resources") * 10),
        _capped(F.col("fails") * 5),
        _capped(n / 100.0 * 100),
    ]
    return both.select(
        "entity_id",
        F.coalesce("os", F.lit("General User")).alias("cohort"),
        F.concat(years.cast("string"), F.lit("y")).alias("account_age"),
        F.bround(rate, 2).alias("maturity_weight"),
        F.when(rate > 0.8, "HIGH").when(rate > 0.5, "MEDIUM").otherwise("LOW").alias("maturity_level"),
        F.array(*vector).alias("behavioral_vector"),
    )


def binned_volume(log: DataFrame) -> DataFrame:
    """(entity_id, n, bin, volume): mean bytes in up to 30 consecutive bins of equal event count."""
    rank = Spec(want=Wanted(sums={"r": F.lit(1)}, totals={"n": F.lit(1)}))
    slim = log.select("entity_id", "event_id", epoch_us(F.col("timestamp")).alias("ts_us"), "bytes_transferred")
    ranked = rank.over(slim, "entity_id")
    edge = F.ceil((F.col("r") - 1) * POINTS / F.greatest(F.col("n") - 1, F.lit(1)))
    ranked = ranked.withColumn("bin", F.greatest(edge - 1, F.lit(0)).cast("int"))
    return ranked.groupBy("entity_id", "n", "bin").agg(F.avg("bytes_transferred").alias("volume"))


def drift_series(log: DataFrame) -> DataFrame:
    """(entity_id, drift_data): bin means scaled to 0..0.08, padded to 30 points with the last one."""
    pairs = F.array_sort(F.collect_list(F.struct("bin", "volume")))  # at most 30 per entity
    series = binned_volume(log).groupBy("entity_id", "n").agg(F.transform(pairs, lambda p: p["volume"]).alias("v"))
    lo, hi = F.array_min("v"), F.array_max("v")
    scaled = F.transform("v", lambda x: (x - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 0.08)
    flat = F.transform("v", lambda x: F.lit(0.02))
    points = F.when(F.col("hi") > F.col("lo"), scaled).otherwise(flat)
    padded = F.concat("points", F.array_repeat(F.element_at("points", -1), F.lit(POINTS) - F.size("points")))
    fitted = F.transform(padded, lambda x: F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(0.10)), 4))
    still = F.array_repeat(F.lit(0.01), POINTS)
    return (
        series.withColumns({"lo": lo, "hi": hi})
        .withColumn("points", points)
        .select("entity_id", F.when(F.col("n") < 2, still).otherwise(fitted).alias("drift_data"))
    )


def requested_profiles(log: DataFrame, requested: DataFrame) -> DataFrame:
    """Profiles of the requested entity_ids; an unknown entity gets neutral defaults."""
    wanted = requested.select("entity_id").distinct()
    found = profiles(log.join(wanted, "entity_id", "left_semi"))
    defaults = {
        "cohort": F.lit("Unknown Cohort"),
        "account_age": F.lit("0.0y"),
        "maturity_weight": F.lit(0.5),
        "maturity_level": F.lit("UNKNOWN"),
        "behavioral_vector": F.array_repeat(F.lit(50), 6),
        "drift_data": F.array_repeat(F.lit(0.01), POINTS),
    }
    joined = wanted.join(found, "entity_id", "left")
    return joined.select("entity_id", *[F.coalesce(c, d).alias(c) for c, d in defaults.items()])


def with_spike(df: DataFrame, above: float = 0.05) -> DataFrame:
    """Add `spike`: value and 0-based index of the series maximum when it exceeds `above`."""
    top = F.array_max("drift_data")
    spike = F.struct(top.alias("value"), (F.array_position("drift_data", top) - 1).alias("index"))
    return df.withColumn("spike", F.when(top > above, spike))
