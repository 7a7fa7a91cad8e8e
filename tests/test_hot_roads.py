"""Crossing the row limit changes the plan only: repeated ids, null ids and null keys."""

import pytest
from conftest import DEFAULTS, START
from pyspark.sql import functions as F

from watchframe.operators.baseline import with_sequential
from watchframe.operators.features import with_address_features, with_behaviour
from watchframe.operators.log import prepared
from watchframe.operators.scans import running_index
from watchframe.plans import detect
from watchframe.schema import FLAT_EVENT
from watchframe.session import materialize


def log_of(spark, rows):
    at = F.timestamp_micros(F.lit(int(START.timestamp() * 1_000_000)) + F.col("n") * 1_000_000)
    df = spark.range(rows).withColumnRenamed("id", "n")
    values = {k: F.lit(v) for k, v in DEFAULTS.items()}
    values |= {"event_id": F.format_string("%05d", "n"), "timestamp": at, "entity_id": F.concat(F.lit("e"), (F.col("n") * 7 % 40).cast("string")),
               "resource_accessed": F.concat(F.lit("r"), (F.col("n") * 11 % 23).cast("string")), "auth_success": F.col("n") % 3 > 0}
    return materialize(df.withColumns(values).select(*[F.col(f.name).cast(f.dataType) for f in FLAT_EVENT]))


def case(spark, name):
    log = log_of(spark, 600)
    if name == "repeated ids":
        return log.unionByName(log.where("event_id < '00080'"))
    if name == "null ids":
        return log.withColumn("event_id", F.when(F.col("event_id") < "00060", F.col("event_id")))
    return log.withColumn("entity_id", F.when(F.col("event_id") % 2 == 0, F.col("entity_id")))


@pytest.mark.parametrize("name", ["repeated ids", "null ids", "null keys"])
@pytest.mark.parametrize("build", [with_address_features, with_behaviour])
def test_same_rows_on_both_roads(spark, name, build):
    log = materialize(prepared(case(spark, name)))
    plain = materialize(build(log))
    spark.conf.set("watchframe.hotRows", "65")
    spark.conf.set("watchframe.blockRows", "40")
    try:
        split = materialize(build(log))
    finally:
        spark.conf.unset("watchframe.hotRows")
        spark.conf.unset("watchframe.blockRows")
    split = split.select(plain.columns)
    assert plain.count() == split.count() == log.count()
    digits = {f.name for f in plain.schema if f.dataType.typeName() == "double"}
    shown = lambda df: df.select(*[F.round(c, 6).alias(c) if c in digits else F.col(c) for c in plain.columns])
    assert shown(plain).exceptAll(shown(split)).count() == 0


def test_running_index_reads_the_narrow_table(spark):
    """The block counts come from the log itself, not from the features above it."""
    log = materialize(prepared(log_of(spark, 50)))
    plan = with_behaviour(log).select("event_id", "ip_freq_encoding", "resource_freq_encoding", "resource_diversity")
    text = plan._jdf.queryExecution().executedPlan().toString()
    narrow = text.count("ReadSchema: struct<ts_us:bigint>")
    assert text.count("FileScan") - narrow == 1 and text.count("Exchange hashpartitioning") - narrow <= 7


@pytest.mark.parametrize("name", ["repeated ids", "null ids", "null keys", "null types"])
def test_baselines_keep_every_row(spark, name):
    """One row out for each row in, a gate that always answers, and the same z-scores for redelivered events."""
    log = materialize(case(spark, name) if name != "null types" else log_of(spark, 600).withColumn("entity_type", F.when(F.col("event_id") % 2 == 0, F.col("entity_type"))))
    for mode in ("sequential", "batched"):
        rows = materialize(detect.with_features_and_rules(log, detect.Settings(baseline_mode=mode)))
        assert rows.count() == log.count() and rows.where("accepted is null or session_duration_zscore is null").count() == 0
        assert rows.columns[: len(log.columns)] == log.columns
    still = with_sequential(materialize(prepared(log).withColumns({c: F.lit(1.0) for c in ("session_duration_raw", "bytes_transferred_raw", "auth_failure_rate", "resource_diversity", "geo_velocity_kmh")})))
    assert still.count() == log.count() and still.where("accepted").count() >= 60  # those of the first minute


def test_running_index_shuffles_rows_once(spark):
    """Hours are few: their counts go to the rows, which are shuffled for their places only."""
    rows = spark.range(50).selectExpr("id as event_id", "id * 1000000000L as ts_us")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = running_index(rows, "i")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # of the join, only the counts may be shuffled beforehand
    assert "BroadcastHashJoin [coalesce(_block" in plan
