"""Hand-made sequences for each detector, on both roads."""

import pytest

from conftest import by_event
from watchframe.operators import rules
from watchframe.operators.log import prepared

KM_PER_DEGREE = 111.19492664455873  # along a meridian, radius 6371 km


@pytest.fixture(params=["plain", "split"], autouse=True)
def road(request):
    if request.param == "split":
        request.getfixturevalue("split_road")


def fail(at, **more):
    return {"at": at, "auth_success": False, **more}


def test_brute_force_bounds_are_inclusive_and_a_success_can_carry_the_hit(make_log):
    rows = [fail(at) for at in (0, 100, 200, 300, 400, 500, 590, 600)] + [{"at": 600.5}]
    df = rules.with_entity_rules(prepared(make_log(rows)))
    assert by_event(df, "recent_failures") == [1, 2, 3, 4, 5, 6, 7, 8, 7]
    rows = [fail(at) for at in (1, 100, 200, 300, 400, 500, 590, 600)] + [{"at": 601}]
    df = rules.with_entity_rules(prepared(make_log(rows)))
    assert by_event(df, "rule_brute_force") == [0, 0, 0, 0, 0, 0, 0, 1, 1]


def test_brute_force_ties_fire_only_on_the_last_row(make_log):
    df = rules.with_entity_rules(prepared(make_log([fail(0) for _ in range(8)])))
    assert by_event(df, "rule_brute_force") == [0] * 7 + [1]


def test_travel_needs_time_and_is_strict(make_log):
    # one degree of latitude at exactly the limit is not above it
    exact = KM_PER_DEGREE / 900 * 3600
    rows = [
        {"entity_id": "same", "at": 0, "geo_lat": 0.0},
        {"entity_id": "same", "at": 0, "geo_lat": 50.0},
        {"entity_id": "slow", "at": 0, "geo_lat": 0.0},
        {"entity_id": "slow", "at": exact + 0.01, "geo_lat": 1.0},
        {"entity_id": "fast", "at": 0, "geo_lat": 0.0},
        {"entity_id": "fast", "at": exact - 0.01, "geo_lat": 1.0},
    ]
    df = rules.with_entity_rules(prepared(make_log(rows)))
    assert by_event(df, "rule_impossible_travel") == [0, 0, 0, 0, 0, 1]


@pytest.mark.parametrize("failures, fires", [(11, 1), (10, 0)])
def test_stuffing_rate(make_log, failures, fires):
    rows = [{"entity_id": f"e{i}", "at": i * 60, "auth_success": i >= failures} for i in range(15)]
    df = rules.with_address_rules(prepared(make_log(rows)))
    assert by_event(df, "ip_targets")[-1] == 15
    assert by_event(df, "rule_credential_stuffing") == [0] * 14 + [fires]


def test_stuffing_counts_each_entity_once_and_forgets_it(make_log):
    rows = [{"entity_id": who, "at": at} for who, at in [("a", 0), ("b", 0), ("a", 500), ("c", 900), ("a", 1400), ("b", 1401)]]
    df = rules.with_address_rules(prepared(make_log(rows)))
    assert by_event(df, "ip_events", "ip_targets") == [(1, 1), (2, 2), (3, 2), (4, 3), (3, 2), (3, 3)]


def test_spoofing_follows_the_last_device(make_log):
    rows = [{"device_mac": m, "at": i} for i, m in enumerate("ABA")]
    df = rules.with_entity_rules(prepared(make_log(rows)))
    assert by_event(df, "rule_device_spoofing") == [0, 1, 1]


def test_hits_and_flags(make_log):
    rows = [fail(i, device_mac="m2" if i == 8 else "m1", geo_lat=60.0 if i == 8 else 10.0) for i in range(9)]
    df = rules.with_rules(make_log(rows))
    hits = by_event(df, "rule_hits")[-1]
    assert [(h.rule, h.mitre, round(h.confidence, 4)) for h in hits] == [
        ("brute_force", "T1110", 0.5625),
        ("impossible_travel", "T1078", 1.0),
        ("device_spoofing", "T1036", 0.8),
    ]
    assert hits[0].detail == "9 failed auths in 10 min"
    assert hits[1].detail == "5560 km in 0.00h (20015087 km/h)"
    assert hits[2].detail == "Fingerprint mismatch: expected os1|m1, got os1|m2"
    flags = rules.flags_of(df["rule_hits"])
    assert by_event(df.withColumns(flags), *flags)[-1] == (1, 1, 0, 1)


def test_missing_values(make_log):
    rows = [{"auth_success": None, "device_mac": None, "source_ip": None}, {"device_mac": None, "source_ip": None}]
    df = prepared(make_log(rows))
    assert by_event(df, "failed", "device", "source_ip") == [(0, "os1|", ""), (0, "os1|", "")]
