"""Both roads of a scan give the same rows, whatever the keys and ties look like."""

import random

import pytest
from pyspark.sql import functions as F

from watchframe.operators.scans import PLAIN, SPLIT, Wanted, global_scan, hot_keys, per_key, running_index


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = [
        # key "a" holds most rows; few distinct timestamps, so ties are the rule
        ("a" if rng.random() < 0.7 else rng.choice("bcd"), rng.randrange(12) * 10, i, rng.choice([None, 1, 2, 5]), rng.randrange(2))
        for i in rng.sample(range(1000), 120)
    ]
    return spark.createDataFrame(data, "k string, ts_us bigint, event_id bigint, v bigint, flag int")


def want():
    return Wanted(
        sums={"total": F.col("v"), "rank": F.lit(1)},
        prev={"before": F.col("v"), "before_id": F.col("event_id")},
        next={"after": F.col("v")},
        first={"head": F.col("v")},
        fills={"known": F.col("v")},
        totals={"all": F.col("v")},
        tails={"last9": (F.col("flag").cast("long"), 9)},
    )


def brute(rows):
    out = {}
    data = sorted(rows.collect(), key=lambda r: (r.k, r.ts_us, r.event_id))
    for r in data:
        mine = [x for x in data if x.k == r.k]
        at = mine.index(r)
        past = mine[:at]
        known = [x.v for x in past if x.v is not None]
        out[r.event_id] = (
            sum(x.v or 0 for x in mine[: at + 1]),
            at + 1,
            past[-1].v if past else None,
            past[-1].event_id if past else None,
            mine[at + 1].v if at + 1 < len(mine) else None,
            mine[0].v,
            known[-1] if known else None,
            sum(x.v or 0 for x in mine),
            sum(x.flag for x in mine[max(0, at - 8) : at + 1]),
        )
    return out


def result(df):
    names = ["total", "rank", "before", "before_id", "after", "head", "known", "all", "last9"]
    return {r[0]: tuple(r)[1:] for r in df.select("event_id", *names).collect()}


def test_plain_scan(rows):
    assert result(PLAIN.scan(rows, ["k"], want())) == brute(rows)


@pytest.mark.parametrize("block", ["1", "7", "40", "1000"])
def test_split_scan(spark, rows, split_road, block):
    spark.conf.set("watchframe.blockRows", block)
    assert result(SPLIT.scan(rows, ["k"], want())) == brute(rows)


@pytest.mark.parametrize("span", [0, 10, 35, 1000])
def test_slides(spark, rows, split_road, span):
    data = rows.collect()
    expected = {
        r.event_id: sum(
            x.flag
            for x in data
            if x.k == r.k and (x.ts_us, x.event_id) <= (r.ts_us, r.event_id) and x.ts_us >= r.ts_us - span
        )
        for r in data
    }
    flag = F.col("flag").cast("long")
    for road in (PLAIN, SPLIT):
        got = road.slide(rows, ["k"], {"s": (span, flag, flag), "all": (5000, flag, flag)}).select("event_id", "s").collect()
        assert dict(map(tuple, got)) == expected


def test_hot_keys_take_the_split_road(spark, rows):
    spark.conf.set("watchframe.hotRows", "40")
    spark.conf.set("watchframe.blockRows", "10")
    try:
        assert [r.k for r in hot_keys(rows, ["k"]).collect()] == ["a"]
        roads = []

        def steps(d, road):
            roads.append(road)
            return road.scan(d, ["k"], want())

        assert result(per_key(rows, "k", steps)) == brute(rows)
        assert roads == [PLAIN, SPLIT]
    finally:
        spark.conf.unset("watchframe.hotRows")
        spark.conf.unset("watchframe.blockRows")
    assert hot_keys(rows, ["k"]) is None


@pytest.mark.parametrize("limit", ["4000000", "119", "30", "0"])
def test_running_index(spark, rows, limit):
    spark.conf.set("watchframe.hotRows", limit)
    try:
        got = dict(map(tuple, running_index(rows, "i").select("event_id", "i").collect()))
    finally:
        spark.conf.unset("watchframe.hotRows")
    ordered = sorted((r.ts_us, r.event_id) for r in rows.collect())
    assert got == {e: i for i, (_, e) in enumerate(ordered, 1)}


@pytest.mark.parametrize("block", ["10", "1000"])
def test_global_scan(spark, rows, block):
    spark.conf.set("watchframe.blockRows", block)
    try:
        got = global_scan(rows, Wanted(sums={"i": F.lit(1)}), ["event_id"]).select("event_id", "i").collect()
    finally:
        spark.conf.unset("watchframe.blockRows")
    assert dict(map(tuple, got)) == {e: i for i, e in enumerate(sorted(r.event_id for r in rows.collect()), 1)}


def test_partition_count_does_not_matter(spark, rows):
    before = result(per_key(rows, "k", lambda d, road: road.scan(d, ["k"], want())))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        shuffled = rows.repartition(5).orderBy(F.rand(1))
        assert result(per_key(shuffled, "k", lambda d, road: road.scan(d, ["k"], want()))) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_block_width_is_the_longest_that_fits(spark):
    from watchframe.operators import scans

    # 40 rows in an hour, 20 of them in one minute, 6 of those in one second
    at = [*range(0, 40_000_000, 2_857_143), *[1_000_000 + i for i in range(6)], *[60_000_000 * (i + 2) for i in range(20)]]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(at)], "ts_us bigint, event_id int")
    widths = {}
    for limit in ("39", "25", "10", "3"):
        spark.conf.set("watchframe.hotRows", limit)
        widths[limit] = scans.block_width(df)
        got = dict(map(tuple, running_index(df, "i").select("event_id", "i").collect()))
        spark.conf.unset("watchframe.hotRows")
        assert got == {e: i for i, (_, e) in enumerate(sorted((t, e) for e, t in enumerate(at)), 1)}
    assert widths == {"39": scans.MINUTE_US, "25": scans.MINUTE_US, "10": scans.SECOND_US, "3": None}
