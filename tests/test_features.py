"""Features against a plain Python walk over the log, on both roads and with many timestamp ties."""

import math
import random

import pytest

from conftest import START, by_event
from watchframe.operators import features
from watchframe.operators.log import prepared

SPAN = 7 * 24 * 3600


def km(a, b):
    """From the chord between the two points."""

    def point(lat, lon):
        y, x = math.radians(lat), math.radians(lon)
        return math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)

    return 2 * 6371 * math.asin(min(1.0, math.dist(point(*a), point(*b)) / 2))


def walk(rows):
    """Expected features, straight from the definitions; rows in log order."""
    expected = []
    for i, r in enumerate(rows):
        past = rows[:i]
        own = [x for x in past if x["entity_id"] == r["entity_id"]]
        upto = [*own, r]
        used = []
        novel_at = []
        for x in upto:
            if x["resource_accessed"] not in used:
                used.append(x["resource_accessed"])
                novel_at.append(x["at"])
        place = (r["geo_lat"], r["geo_lon"])
        gap = r["at"] - own[-1]["at"] if own else 0.0
        speed = km((own[-1]["geo_lat"], own[-1]["geo_lon"]), place) / max(gap / 3600, 0.001) if own else 0.0
        away = km((upto[0]["geo_lat"], upto[0]["geo_lon"]), place)
        devices = {x["device_os"] + x["device_mac"] for x in own}
        recent = upto[-50:]
        expected.append(
            {
                "time_since_last": gap,
                "session_frequency_1h": len(own),
                "auth_failure_rate": sum(not x["auth_success"] for x in recent) / len(recent),
                "resource_novelty": r["resource_accessed"] not in {x["resource_accessed"] for x in own},
                "resource_diversity": len(used),
                "unique_entities_per_ip": len({x["entity_id"] for x in [*past, r] if x["source_ip"] == r["source_ip"]}),
                "privilege_expansion_rate": 1 / len(used) if len(used) > 1 else 0,
                "privilege_expansion_velocity": sum(r["at"] - t <= SPAN for t in novel_at),
                "geo_velocity_kmh": speed,
                "impossible_travel_flag": speed > 900,
                "geo_distance_from_primary": away,
                "geo_anomaly_score": 0.3 * min(speed / 1000, 1) + 0.3 * (speed > 900) + 0.4 * min(away / 10000, 1),
                "device_stability_index": len({x["device_mac"] for x in upto}),
                "new_device_flag": bool(own) and r["device_os"] + r["device_mac"] not in devices,
                "resource_freq_encoding": sum(x["resource_accessed"] == r["resource_accessed"] for x in [*past, r]) / (i + 1),
                "ip_freq_encoding": sum(x["source_ip"] == r["source_ip"] for x in [*past, r]) / (i + 1),
            }
        )
    return expected


def random_rows(seed, n=150):
    rng = random.Random(seed)
    at = sorted(rng.choice(range(0, 30)) * 86400 + rng.choice([0, 0, 3600]) for _ in range(n))
    return [
        {
            "at": t,
            "entity_id": "e1" if rng.random() < 0.6 else rng.choice(["e2", "e3"]),
            "source_ip": rng.choice(["i1", "i2"]),
            "resource_accessed": rng.choice("abcdefgh"),
            "auth_success": rng.random() < 0.7,
            "geo_lat": rng.choice([0.0, 0.0, 40.0]),
            "geo_lon": rng.choice([0.0, 1.0]),
            "device_os": rng.choice(["w", "u"]),
            "device_mac": rng.choice(["m1", "m1", "m2", "m3"]),
        }
        for t in at
    ]


@pytest.mark.parametrize("road, seed", [("plain", 1), ("plain", 2), ("split", 1)])
def test_features_match_a_walk_over_the_log(request, make_log, road, seed):
    if road == "split":
        request.getfixturevalue("split_road")
    rows = random_rows(seed)
    expected = walk(rows)
    names = list(expected[0])
    got = by_event(features.with_behaviour(prepared(make_log(rows))), *names)
    for row, want in zip(got, expected):
        assert dict(zip(names, row)) == pytest.approx({k: float(v) for k, v in want.items()}, rel=1e-6, abs=1e-3)


def test_clock_fields(make_log):
    at = {"05:59": (1, 0), "06:00": (0, 0), "08:00": (0, 1), "18:00": (0, 1), "18:01": (0, 0), "22:00": (0, 0), "22:01": (1, 0)}
    nine = START.hour * 60
    rows = [{"at": (int(t[:2]) * 60 + int(t[3:]) - nine) * 60 + 30} for t in at]
    df = prepared(make_log(rows)).withColumns(features.temporal())
    assert by_event(df, "is_off_hours", "is_work_hours") == list(at.values())
    assert set(by_event(df, "day_of_week")) == {0.0}
    sunday = prepared(make_log([{"at": 6 * 86400}])).withColumns(features.temporal())
    assert by_event(sunday, "day_of_week", "is_weekend") == [(6.0, 1.0)]
    noon = prepared(make_log([{"at": 3 * 3600 + 59}])).withColumns(features.temporal())
    assert by_event(noon, "hour_sin", "hour_cos")[0] == pytest.approx((0.0, -1.0), abs=1e-12)


def test_clock_fields_ignore_the_session_time_zone(spark, make_log):
    log = make_log([{"at": i * 3600} for i in range(24)])
    want = by_event(prepared(log).withColumns(features.temporal()), *features.temporal())
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        got = by_event(prepared(log).withColumns(features.temporal()), *features.temporal())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_novelty_span_includes_its_far_end(make_log):
    rows = [{"at": 0, "resource_accessed": "a"}, {"at": SPAN, "resource_accessed": "b"}, {"at": SPAN + 1, "resource_accessed": "b"}]
    df = features.with_behaviour(prepared(make_log(rows)))
    assert by_event(df, "privilege_expansion_velocity") == [1, 2, 1]


def test_no_time_between_two_places(make_log):
    rows = [{"at": 0, "geo_lat": 0.0, "geo_lon": 0.0}, {"at": 0, "geo_lat": 1.0, "geo_lon": 0.0}]
    df = features.with_behaviour(prepared(make_log(rows)))
    assert by_event(df, "geo_velocity_kmh")[1] == pytest.approx(111.19492664 / 0.001)


def test_new_device_remembers_all_devices(make_log):
    df = features.with_behaviour(prepared(make_log([{"device_mac": m} for m in "ABA"])))
    assert by_event(df, "new_device_flag", "fingerprint_mismatch") == [(0, 0), (1, 1), (0, 0)]


def test_windowed_frequency(make_log):
    rows = [{"at": a} for a in (0, 1800, 3600, 3601)]
    df = features.with_behaviour(prepared(make_log(rows)), windowed_frequency=True)
    assert by_event(df, "session_frequency_1h") == [0, 1, 2, 2]


def test_command_entropy(spark, make_log):
    from watchframe.sources.files import with_commands

    log = with_commands(make_log([{"command_sequence": c} for c in ("['a','a','b','b']", "['a']", None, "[]")]))
    df = prepared(log)
    assert by_event(df.withColumns(features.raw_values(True)), "command_entropy") == [1.0, 0.0, 0.0, 0.0]
    assert set(by_event(df.withColumns(features.raw_values(False)), "command_entropy")) == {0.0}


def test_full_layout(make_log):
    from watchframe.schema import FEATURES, numeric_features

    df = features.compute_features(make_log(random_rows(5, 20)))
    assert df.columns == ["event_id", *FEATURES] and len(FEATURES) == 37
    assert df.count() == 20
    assert numeric_features(FEATURES) == [
        "session_frequency_1h", "auth_failure_rate", "session_duration_raw", "bytes_transferred_raw", "command_entropy",
        "privilege_expansion_rate", "privilege_expansion_velocity", "geo_velocity_kmh", "device_stability_index",
        "resource_freq_encoding", "ip_freq_encoding", "session_duration_zscore", "bytes_transferred_zscore", "hour_zscore",
        "auth_failure_rate_zscore", "resource_diversity_zscore", "geo_velocity_kmh_zscore",
    ]
