"""Streams against their batch twins, in several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import START, by_event
from watchframe.operators import baseline, rules
from watchframe.operators.log import prepared
from watchframe.streaming import stateful

HOUR_US = 3_600_000_000


@pytest.fixture
def arriving(spark, make_log, tmp_path):
    """The prepared log, and a stream of it in four files read one per micro-batch."""
    rng = random.Random(2)
    rows = [
        {"at": i * 300, "entity_id": rng.choice("abc"), "device_mac": rng.choice("mn"), "geo_lat": rng.random(), "auth_success": rng.random() < 0.6,
         "entity_type": rng.choice(["user", "edge_device"])}
        for i in range(80)
    ]
    log = prepared(make_log(rows))
    for i in range(4):
        part = log.where(F.col("event_id").between(f"{i * 20:05d}", f"{i * 20 + 19:05d}"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return log, stream


def test_previous_event(spark, arriving, tmp_path):
    log, stream = arriving
    names, path = ["prev_us", "prev_lat", "prev_device"], str(tmp_path / "previous")
    stateful.start_previous(stream, path).awaitTermination()
    sink = stateful.PreviousSink(path)
    want = by_event(rules.with_entity_rules(log), *names)
    assert by_event(sink.rows(spark), *names) == want
    assert spark.read.parquet(f"{path}/state/batch=3").count() == 3  # a row per entity
    sink(log.where("event_id between '00040' and '00059'"), 2)  # a batch that is run again changes nothing
    assert by_event(sink.rows(spark), *names) == want


def test_previous_event_of_hot_entities(spark, make_log, split_road, tmp_path):
    log = prepared(make_log([{"at": i, "entity_id": "a" if i % 3 else "b", "device_mac": f"m{i}"} for i in range(40)]))
    sink = stateful.PreviousSink(str(tmp_path))
    sink(log.where("event_id < '00025'"), 0)
    sink(log.where("event_id >= '00025'"), 1)
    names = ["prev_us", "prev_device"]
    assert by_event(sink.rows(spark), *names) == by_event(rules.with_entity_rules(log), *names)


def test_failure_counts(arriving):
    """Open windows included; an entity with rows in several panes of a window counts once."""
    log, stream = arriving
    panes = stateful.drained_windows(stateful.failure_panes(stream, "source_ip", "1 hour", "10 minutes"), "source_ip", "entity_id")
    streamed = stateful.failure_counts(panes, "source_ip", "2 hours", "1 hour")
    batch = log.groupBy(F.window("timestamp", "2 hours", "1 hour"), "source_ip").agg(
        F.count("*").alias("events"), F.sum("failed").cast("long").alias("failures"), F.count_distinct("entity_id").alias("targets")
    )
    assert streamed.count() == batch.count() and streamed.exceptAll(batch.select(streamed.columns)).count() == 0


def test_late_rows_are_dropped(spark, make_log, tmp_path):
    def put(at):
        prepared(make_log([{"at": a} for a in at])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([0, 10])
    put([7200])
    put([7201])  # Spark drops late rows by the watermark of the batch before
    put([20, 14400])
    schema = prepared(make_log([{}])).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rates = stateful.drained(stateful.cohort_rates(stream, F.col("failed") > 0, "1 minute", "10 minutes"))
    got = {r.window.start.timestamp() - START.timestamp(): r.events for r in rates.collect()}
    assert got == {0.0: 2, 7200.0: 2}


def test_baseline_stream_and_replay(spark, arriving, tmp_path):
    log, _ = arriving
    zeros = {c: F.lit(1.0) for c in ("auth_failure_rate", "resource_diversity", "geo_velocity_kmh")}
    kind = F.when(F.col("entity_id") == "a", "edge_device").otherwise("user")
    rows = log.withColumns({**zeros, "entity_type": kind, "session_duration_raw": F.col("geo_lat"), "bytes_transferred_raw": F.col("geo_lon")})
    batches = [rows.where(F.col("event_id").between(f"{i * 40:05d}", f"{i * 40 + 39:05d}")) for i in range(2)]
    sink = stateful.BaselineSink(str(tmp_path / "sink"))
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
        stateful.start_baseline(stream, sink.path).awaitTermination()
    o, state, want = baseline.Options(), None, {}
    for batch in batches:
        part = baseline.score_slice(baseline.measured(batch), state, o)
        state = baseline.update_state(part, state, o)
        want |= {r.event_id: r.hour_zscore for r in part.collect()}

    def streamed():
        return {r.event_id: r.hour_zscore for r in sink.scored(spark).collect()}

    assert streamed() == pytest.approx(want)
    sink(batches[1], 1)  # a batch that runs again leaves everything as it was
    assert streamed() == pytest.approx(want)
    assert sink.state_before(spark, 2).entities.orderBy("entity_id").collect() == state.entities.orderBy("entity_id").collect()
