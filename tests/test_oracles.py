"""Every registered query against its DuckDB twin, on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import connect, differences

SF_DIR = "/root/testdata/sf0.001"
# model fits take long and have no twin; test_models covers them
QUERIES = [q for q in entry.queries() if q in entry.oracle_sql() and q != "explanation_sums"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {q for q in entry.queries() if q != "pipeline" and not q.startswith("op")}  # the others are optional and tested apart
    assert own - set(entry.oracle_sql()) == {
        "outlier_combined", "risk_scores", "alerts", "evaluation", "explanations",
    }


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert not differences(got, duck.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "rule", "detail", "mitre", "confidence"] and df.count() > 0


def test_hot_and_cold_keys_together(spark):
    """Features and rules with some keys above the limit and some below equal those without hot keys."""
    from pyspark.sql import functions as F

    from watchframe.plans import detect, queries
    from watchframe.schema import FEATURES, RULE_FLAGS
    from watchframe.session import materialize

    def table():
        df = detect.with_features_and_rules(queries.read_access_log(spark, SF_DIR), queries.SETTINGS)
        return materialize(df.select("event_id", *[F.round(c, 6).alias(c) for c in FEATURES], *RULE_FLAGS, "rule_hits"))

    plain = table()
    spark.conf.set("watchframe.hotRows", "65")
    spark.conf.set("watchframe.blockRows", "40")
    try:
        split = table()
    finally:
        spark.conf.unset("watchframe.hotRows")
        spark.conf.unset("watchframe.blockRows")
    assert plain.count() == split.count() == 1000
    assert plain.exceptAll(split).count() == 0
