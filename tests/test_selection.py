"""Exact order statistics, never-used resources and pruned timelines against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchframe.operators import labels, rules, selection, serving
from watchframe.operators.log import prepared


@pytest.mark.parametrize("bins", [2, 4096])
def test_order_statistics(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    rng = random.Random(bins)
    for values in (
        [3.0],
        [1.0] * 40,
        [rng.gauss(0, 1) for _ in range(200)],
        [rng.choice([0.0, -0.0, 1e-300, 1e300, -1e300, 5e-324, 1.0, math.nextafter(1.0, 2)]) for _ in range(60)],
    ):
        df = spark.createDataFrame([(x,) for x in [*values, None, math.nan]], "v double")
        ranks = sorted({0, len(values) // 3, len(values) - 1})
        assert selection.order_statistics(df, "v", ranks) == [sorted(values)[r] for r in ranks]
    assert selection.quantile(spark.createDataFrame([(float(x),) for x in range(11)], "v double"), "v", 0.98) == pytest.approx(np.quantile(range(11), 0.98))
    assert selection.quantile(df.limit(0), "v", 0.5) is None
    with pytest.raises(ValueError):
        selection.order_statistics(df, "v", [10**6])


@pytest.mark.parametrize("size", [4, 16_384])
def test_unused_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(labels, "RESOURCES", size)
    rng = random.Random(size)
    used = [(rng.choice(["a", "b", None]), rng.choice([None, *[f"r{i}" for i in range(60)]])) for _ in range(80)] + [("c", "gone")]
    log = spark.createDataFrame(used, "entity_id string, resource_accessed string")
    catalog = spark.createDataFrame([(f"r{i}",) for i in range(50)] + [("r1",), (None,)], "resource_accessed string")
    want = sorted((str(e), f"r{i}") for e in {e for e, _ in used} for i in range(50) if (e, f"r{i}") not in used)
    assert sorted((str(r[0]), r[1]) for r in labels.unused_pairs(log, catalog).collect()) == want
    assert {r[0]: len(r[1]) for r in labels.unused_resources(log, catalog).collect()}["c"] == 50


def test_timeline_reads_only_what_its_rules_can(spark, make_log):
    """Rows far from the entity's addresses and times do not go through the rules, and the timeline is the same."""
    rng = random.Random(3)
    rows = [{"at": i * 60, "entity_id": f"e{rng.randrange(40)}", "source_ip": f"10.0.0.{rng.randrange(9)}", "auth_success": rng.random() < 0.4} for i in range(300)]
    log = prepared(make_log(rows))
    t = rules.Thresholds(30, 2, 900.0, 60, 3, 0.3)
    near = serving.around_entity(log, "e7", t.stuffing_minutes * 60_000_000)
    assert 0 < near.count() < 200
    pruned = serving.entity_timeline(rules.with_rules(near, t), "e7").collect()
    assert pruned == serving.entity_timeline(rules.with_rules(log, t), "e7").collect() and any(r.rules for r in pruned)
