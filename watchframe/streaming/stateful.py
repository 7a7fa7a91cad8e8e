"""Streaming forms of the ordered operators.

State is bounded: the last event per entity, counters per open pane and entity, or a stored baseline per key.
Batch twins of each are in `operators`; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchframe.operators import baseline, rules
from watchframe.operators.carried import compacted, resumed
from watchframe.operators.scans import Spec
from watchframe.session import materialize, scratch_path

def _previous() -> Spec:
    return Spec(want=rules.previous_event(), inputs=frozenset({"ts_us", "geo_lat", "geo_lon", "device"}))


class PreviousSink:
    """foreachBatch body: gives each event the time, place and device of its entity's previous one.

    A batch goes on where the stored last events of the batch before it end, on the roads of `scans`: hot entities are
    split, and no Python runs. Rows and last events are written under the batch's own number, so that a batch
    that is run again overwrites its output with the same. Batches must come in time order.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        spec = _previous()
        kept = sorted(spec.inputs | {"event_id", "entity_id"})
        rows = materialize(df.select(*kept), "batch")
        old = spark.read.schema(rows.schema).parquet(f"{self.path}/state/batch={batch - 1}") if batch else None
        resumed(spec, rows, "entity_id", old).write.mode("overwrite").parquet(f"{self.path}/out/batch={batch}")
        end = rows.agg(F.max("ts_us")).first()[0] or 0
        last = compacted(spec, rows, "entity_id", old, end).select(rows.columns)
        last.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")

    def rows(self, spark) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/out").parquet(f"{self.path}/out").drop("batch")


def start_previous(stream: DataFrame, path: str, **trigger: Any) -> StreamingQuery:
    """Run `PreviousSink` on a prepared stream."""
    writer = stream.writeStream.foreachBatch(PreviousSink(path)).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def failure_panes(stream: DataFrame, key: str, slide: str, late: str) -> DataFrame:
    """Events and failures per key, entity and pane: the tumbling windows of which sliding ones consist.

    A row of state is two counts. No row holds a set: an entity of a key and pane is a row of its own.
    """
    panes = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", slide), key, "entity_id")
    return panes.agg(F.count("*").alias("events"), F.sum("failed").cast("long").alias("failures"))


def failure_counts(panes: DataFrame, key: str, width: str, slide: str) -> DataFrame:
    """Events, failures and distinct entities per key and sliding window, from panes; `width` is a multiple of `slide`.

    The second of two aggregations: panes of an entity become its windows, and then the entities of a window are counted.
    """
    start = F.window("_at", width, slide)
    rows = panes.withColumn("_at", F.col("window.start")).drop("window").withColumn("window", start)
    entities = rows.groupBy("window", key, "entity_id").agg(F.sum("events").alias("events"), F.sum("failures").alias("failures"))
    return entities.groupBy("window", key).agg(
        F.sum("events").alias("events"), F.sum("failures").alias("failures"), F.count("*").alias("targets")
    )


def cohort_rates(stream: DataFrame, anomalous: Column, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events and anomalies per tumbling window and cohort: the rate tile, and the series drift runs on."""
    windows = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "entity_type")
    return windows.agg(F.count("*").alias("events"), F.sum(anomalous.cast("long")).alias("anomalies"))


class BaselineSink:
    """foreachBatch body: scores a micro-batch against the stored baseline, writes it, moves the baseline on.

    Each batch writes its scored rows and its state under its own number. A batch that is run again finds
    the state of the batch before it and overwrites its own output, so replays change nothing.
    """

    def __init__(self, path: str, options: baseline.Options = baseline.Options()):
        self.path = path
        self.options = options

    def state_before(self, spark, batch: int) -> baseline.State | None:
        return baseline.load_state(spark, f"{self.path}/state/batch={batch - 1}") if batch > 0 else None

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark, target = df.sparkSession, f"{self.path}/scored/batch={batch}"
        state = self.state_before(spark, batch)
        scored = baseline.score_slice(baseline.measured(df), state, self.options)
        scored.write.mode("overwrite").parquet(target)
        rows = spark.read.schema(scored.schema).parquet(target)
        baseline.updated(rows, state, self.options).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")

    def scored(self, spark) -> DataFrame:
        return baseline.tidy(spark.read.option("basePath", f"{self.path}/scored").parquet(f"{self.path}/scored"))


def start_baseline(stream: DataFrame, path: str, options: baseline.Options = baseline.Options(), **trigger: Any) -> StreamingQuery:
    """Run the batched baseline on a stream of feature rows."""
    sink = BaselineSink(path, options)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drained(stream: DataFrame, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run a stream over everything available now into a parquet sink and read that back."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return after(spark.read.schema(stream.schema).parquet(f"{path}/out"))


def drained_windows(stream: DataFrame, *keys: str) -> DataFrame:
    """Run a windowed aggregate over everything available now: the last state of every window, open ones included."""
    spark = stream.sparkSession
    path = scratch_path(spark, "windows")

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    writer = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    values = [c for c in stream.columns if c not in ("window", *keys)]
    latest = rows.groupBy("window", *keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return latest.select("window", *keys, *[F.col(f"_last.{c}") for c in values])
