"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`--scale 1,10,100` also times features and rules over the log copied that many times under new entities
and addresses, and prints a JSON line with events per second for each size.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.plans import detect
from watchframe.plans import queries as q
from watchframe.session import get_session, materialize
from watchframe.sources.adapter import read_access_log

HEADLINE = [
    "rule_brute_force",
    "rule_credential_stuffing",
    "rule_flags",
    "feat_geo",
    "feat_device",
    "feat_freq_encoding",
    "features_and_rules",
    "baseline_sequential",
    "baseline_batched",
    "markov_surprise",
    "metrics_report",
    "entity_profile",
    "entity_drift_series",
    "unused_resources",
    "ecod_exact",
    "outlier_combined",
    "drift_buckets",
    "train_and_score",
]


def features_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.with_features_and_rules(read_access_log(spark, sf_dir), q.SETTINGS)


def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.run(read_access_log(spark, sf_dir), q.SETTINGS)[1]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def copied(log: DataFrame, times: int) -> DataFrame:
    """Every event `times` over, each copy with entities and addresses of its own."""
    n = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    wide = log.withColumn("_n", n)
    return wide.withColumns(
        {
            "event_id": F.col("event_id") * times + F.col("_n"),
            "entity_id": F.concat_ws("-", "entity_id", "_n"),
            "source_ip": F.concat_ws("-", "source_ip", "_n"),
            "resource_accessed": F.concat_ws("-", "resource_accessed", "_n"),
            "session_duration": F.col("session_duration") + F.col("_n") / 1000,  # no exact copies of a first event
        }
    ).drop("_n")


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--scale", default="")
    scale = args.parse_args().scale
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")}
    spark = get_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    own = {"features_and_rules": features_and_rules, "train_and_score": train_and_score}
    registered = {**q.queries(), **own}
    run(read_access_log(spark, sf_dir))  # start-up is not a query's time
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(registered[name](spark, sf_dir))
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    events = read_access_log(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "features_and_rules_events_per_sec": round(events / took["features_and_rules"], 1),
            }
        ),
        flush=True,
    )
    sizes = {}
    for times in filter(None, scale.split(",")):
        log = materialize(copied(read_access_log(spark, sf_dir), int(times)))
        start = time.perf_counter()
        run(detect.with_features_and_rules(log, q.SETTINGS))
        seconds = time.perf_counter() - start
        sizes[times] = {"events": events * int(times), "sec": round(seconds, 2), "events_per_sec": round(events * int(times) / seconds)}
        print(times, sizes[times], file=sys.stderr, flush=True)
    if sizes:
        print(json.dumps({"metric": "features and rules by size", "sizes": sizes}), flush=True)


if __name__ == "__main__":
    main()
