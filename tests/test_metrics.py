import random

import pytest
from pyspark.sql import functions as F

from watchframe.operators import metrics


@pytest.fixture
def scored(spark):
    def build(rows):
        return spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)], "event_id bigint, label_int int, predicted_int int, risk double"
        )

    return build


def value(df):
    return df.first()[0]


def test_average_precision_groups_ties(scored):
    df = scored([(1, 0, 0.9), (0, 0, 0.9), (1, 0, 0.5), (0, 0, 0.1)])
    assert value(metrics.average_precision(metrics.score_curve(df))) == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    none = metrics.score_curve(scored([(0, 0, 0.9)]))
    assert value(metrics.average_precision(none)) == 0.0
    assert value(metrics.roc_auc(none)) is None


@pytest.mark.parametrize("n, fraction, k", [(50, 0.01, 1), (50, 0.1, 5), (3, 0.01, 1), (200, 0.01, 2), (50, 1.0, 50)])
def test_precision_at_k(spark, scored, n, fraction, k):
    rng = random.Random(n)
    rows = [(rng.randrange(2), 0, rng.choice([10.0, 20.0, 30.0])) for _ in range(n)]
    df = scored(rows)
    top = sorted(range(n), key=lambda i: (-rows[i][2], i))[:k]
    got = metrics.precision_at_k(df, metrics.score_curve(df), fraction=fraction).first()
    assert got["k"] == k
    assert got["precision_at_k"] == pytest.approx(sum(rows[i][0] for i in top) / k)


@pytest.mark.parametrize("block", ["3", "1000"])
def test_ranking_metrics_against_pairs(spark, scored, block):
    rng = random.Random(5)
    rows = [(rng.randrange(3), 0, float(rng.randrange(15))) for _ in range(80)]
    pos = [r[2] for r in rows if r[0]]
    neg = [r[2] for r in rows if not r[0]]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    spark.conf.set("watchframe.blockRows", block)
    try:
        curve = metrics.score_curve(scored(rows))
        assert value(metrics.roc_auc(curve)) == pytest.approx(auc)
        ap, seen, hits = 0.0, 0, 0
        for s in sorted({r[2] for r in rows}, reverse=True):
            step = [r for r in rows if r[2] == s]
            seen += len(step)
            new = sum(r[0] > 0 for r in step)
            hits += new
            ap += new / len(pos) * hits / seen
        assert value(metrics.average_precision(curve)) == pytest.approx(ap)
    finally:
        spark.conf.unset("watchframe.blockRows")


def test_class_report_and_matrix(scored):
    df = scored([(0, 0, 1.0), (0, 1, 60.0), (1, 1, 90.0), (2, 1, 90.0), (1, 3, 10.0)])
    counts = metrics.confusion_counts(df)
    report = {(r["metric"], r["class"]): r["value"] for r in metrics.class_report(counts).collect()}
    assert report["precision", "brute_force"] == pytest.approx(1 / 3)
    assert report["recall", "brute_force"] == 0.5
    assert report["f1", "brute_force"] == pytest.approx(0.4)
    # never predicted, and never a label: 0 rather than null
    assert report["precision", "impossible_travel"] == 0.0
    assert report["recall", "credential_stuffing"] == 0.0
    assert report["support", "credential_stuffing"] == 0.0
    assert report["accuracy", "all"] == 0.4
    assert report["macro_f1", "all"] == pytest.approx((2 / 3 + 0.4) / 4)
    assert report["f1", "weighted avg"] == pytest.approx((2 * 2 / 3 + 2 * 0.4) / 5)
    matrix = {r["label_int"]: [r[f"predicted_{i}"] for i in range(4)] for r in metrics.confusion_matrix(counts).collect()}
    assert matrix == {0: [1, 1, 0, 0], 1: [0, 1, 0, 1], 2: [0, 1, 0, 0], 3: [0, 0, 0, 0]}
    assert value(metrics.false_positive_rate(df)) == 0.5
    assert value(metrics.false_positive_rate(df.where("label_int > 0"))) == 0.0


def test_class_weights(scored):
    df = scored([(5, 0, 0.0)] * 2 + [(1, 0, 0.0)] * 6)
    weights = {r["label_int"]: r["weight"] for r in metrics.class_weights(df, boosts={5: 2.0}).collect()}
    assert weights == {5: 8 / (2 * 2) * 2, 1: 8 / (2 * 6)}


def test_report_and_summary(scored):
    report = metrics.metrics_report(scored([(1, 1, 90.0), (0, 0, 10.0), (0, 0, 20.0)]))
    row = metrics.report_summary(report).first().asDict()
    assert row == pytest.approx(dict.fromkeys(row, 1.0))


def test_daily_sketches_add_up(spark, tmp_path):
    """Distinct entities over overlapping days, within three standard errors by sketch and exactly beside it."""
    rows = spark.range(40_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 13).alias("timestamp"),
        F.concat(F.lit("e"), (F.col("id") * 7919 % 9000).cast("string")).alias("entity_id"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("edge_device").alias("entity_type"),
        (F.col("id") % 50 == 0).cast("int").alias("label_int"),
    )
    metrics.daily_stats(rows).save(str(tmp_path))
    daily = metrics.load_daily(spark, str(tmp_path))
    want = rows.where(F.to_date("timestamp").between("2024-01-02", "2024-01-04"))
    exact = daily.between("2024-01-02", "2024-01-04", exact=True).first()
    close = daily.between("2024-01-02", "2024-01-04").first()
    assert exact.events == close.events == want.count()
    assert exact.entities == want.select("entity_id").distinct().count() and exact.service_accounts == 0
    for c in ("entities", "users", "edge_devices"):
        assert abs(close[c] - exact[c]) <= 3 * 1.04 / 2**6 * exact[c]
    none = daily.between("2030-01-01", "2030-01-02", exact=True).first()
    assert none.events is None and none.entities == 0
