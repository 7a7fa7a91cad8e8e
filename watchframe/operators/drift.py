"""Shifts of the anomaly rate per cohort.

The log is reduced to counts per (cohort, time bucket) by a distributed aggregation. That series, whose
length depends on the time range and not on the rows, streams through the adaptive-window test (ADWIN:
Bifet and Gavalda, 2007). The window is an exponential histogram: a step costs, and its state holds, a number
of entries that grows with the logarithm of the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions.scalars import HOUR_US

EVENTS = "cohort string, type string, message string, metadata map<string,string>, bucket_us bigint"


def buckets(events: DataFrame, anomalous: Column, width_us: int = HOUR_US) -> DataFrame:
    """(cohort, bucket_us, n, anomalies) from events with `entity_type` and `ts_us`."""
    start = F.col("ts_us") - F.pmod("ts_us", F.lit(width_us))
    return events.groupBy(F.col("entity_type").alias("cohort"), start.alias("bucket_us")).agg(
        F.count("*").alias("n"), F.sum(anomalous.cast("long")).alias("anomalies")
    )


def _cuts(n: np.ndarray, hits: np.ndarray, delta: float, min_side: int) -> bool:
    """Whether some split of the window has means too far apart."""
    total, ones = n.sum(), hits.sum()
    n0, h0 = np.cumsum(n)[:-1], np.cumsum(hits)[:-1]
    n1, h1 = total - n0, ones - h0
    usable = (n0 >= min_side) & (n1 >= min_side)
    if not usable.any():
        return False
    n0, h0, n1, h1 = n0[usable], h0[usable], n1[usable], h1[usable]
    inverse = 1 / n0 + 1 / n1
    confidence = np.log(2 * np.log(total) / delta)
    rate = ones / total
    bound = np.sqrt(2 * inverse * rate * (1 - rate) * confidence) + 2 / 3 * inverse * confidence
    return bool((np.abs(h0 / n0 - h1 / n1) > bound).any())


#: Entries of one size in a window before the two oldest of them become one of the next size.
PER_SIZE = 5


@dataclass
class Window:
    """An adaptive window as an exponential histogram: entries (n, hits, buckets, size), the oldest first.

    An entry of size s stands for 2^s time buckets in a row; sizes never grow towards the new end, and there are at
    most `per_size` of each. Where the means of two sides of some entry's end lie too far apart, old entries are
    dropped until none do. With `per_size` above the series' length nothing is merged and every split is tested.
    """

    delta: float
    min_side: int
    per_size: int = PER_SIZE
    entries: list[tuple[int, int, int, int]] = field(default_factory=list)

    def add(self, n: int, hits: int) -> int:
        """Take in the next time bucket; how many old ones were dropped."""
        self.entries.append((n, hits, 1, 0))
        size = 0
        while sum(e[3] == size for e in self.entries) > self.per_size:
            i = next(i for i, e in enumerate(self.entries) if e[3] == size)
            a, b = self.entries[i : i + 2]
            self.entries[i : i + 2] = [(a[0] + b[0], a[1] + b[1], a[2] + b[2], size + 1)]
            size += 1
        dropped = 0
        while len(self.entries) > 1 and self.shifted():
            dropped += self.entries.pop(0)[2]
        return dropped

    def shifted(self) -> bool:
        counts = np.array([e[:2] for e in self.entries], dtype=np.float64)
        return _cuts(counts[:, 0], counts[:, 1], self.delta, self.min_side)

    def rate(self) -> float:
        return sum(e[1] for e in self.entries) / max(1, sum(e[0] for e in self.entries))


def drift_events(series: DataFrame, delta: float = 0.001, min_side: int = 5, per_size: int = PER_SIZE) -> DataFrame:
    """One row per bucket at which a cohort's rate is found to have shifted. A null cohort is a cohort."""

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cohort, window = object(), None  # cohorts come one after another, each in time order
        for batch in batches:
            found = []
            for at, kind, n, hits in batch[["bucket_us", "cohort", "n", "anomalies"]].itertuples(index=False):
                if kind != cohort:
                    cohort, window = kind, Window(delta, min_side, per_size)
                dropped = window.add(int(n), int(hits))
                if dropped:
                    message = (
                        f"Anomaly rate distribution shift detected for cohort '{cohort}'. Baseline may need recalibration."
                    )
                    facts = {"dropped_buckets": str(dropped), "rate": f"{window.rate():.6f}"}
                    found.append((cohort, "distribution_shift", message, facts, int(at)))
            yield pd.DataFrame(found, columns=["cohort", "type", "message", "metadata", "bucket_us"])

    lined = series.select("cohort", "bucket_us", "n", "anomalies").repartition("cohort").sortWithinPartitions("cohort", "bucket_us")
    return lined.mapInPandas(detect, EVENTS)


def active_cohorts(series: DataFrame) -> DataFrame:
    return series.select("cohort").distinct()


def after_reset(series: DataFrame, resets: DataFrame) -> DataFrame:
    """The series without what came before a cohort's reset; `resets` has (cohort, reset_us)."""
    joined = series.join(resets, "cohort", "left")
    return joined.where(F.col("reset_us").isNull() | (F.col("bucket_us") >= F.col("reset_us"))).drop("reset_us")
