"""Spark session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def get_session(app: str = "watchframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="watchframe-")
    return _local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/watchframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partition: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where a result feeds several jobs or must not be computed twice. It stays columnar, so later
    readers still prune, and it survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, partitionBy=partition)
    return spark.read.schema(df.schema).parquet(path)


def setting(df: DataFrame, key: str, default: int) -> int:
    """Integer session setting `watchframe.<key>`."""
    return int(df.sparkSession.conf.get(f"watchframe.{key}", str(default)))
